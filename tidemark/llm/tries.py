"""Depth-limited count tries over hashed words: built for a shard, cut at splitters, serialised in sorted order, and merged.

A trie's words are sorted 64-bit hashes; each level is three arrays (parent's place in the level above, word's place among the words, count), sorted by parent and word,
so a level read in order is a walk of the trie. A splitter is a path; a trie is cut into the ranges between splitters. A range that begins inside a subtree
also carries the nodes above its beginning with their counts, from every shard that has them, so a walk over a merged range knows the counts of all prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard

Path = tuple[int, ...]


@dataclass
class Trie:
    words: np.ndarray
    parents: list[np.ndarray]
    labels: list[np.ndarray]
    counts: list[np.ndarray]

    @cached_property
    def keys(self) -> list[np.ndarray]:
        """For each level parent and word in one number, in rising order."""
        return [p * max(1, len(self.words)) + w for p, w in zip(self.parents, self.labels, strict=True)]


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the sums of their counts, and the place of each input among them. The stable sort merges runs that are in order already."""
    order = np.argsort(keys, kind="stable")
    inorder = keys[order]
    begins = np.ones(len(keys), dtype=bool)
    begins[1:] = inorder[1:] != inorder[:-1]
    at = np.flatnonzero(begins)
    sums = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(begins) - 1
    return inorder[at], sums.astype(np.int64), place


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the place of each input among them."""
    found, _, place = _summed(keys, None)
    return found, place


def built(hashes: np.ndarray, joined: np.ndarray, depth: int) -> Trie:
    """The trie of all runs of one to ``depth`` words; ``joined`` tells which words follow the one before without a break."""
    words, _, label = _summed(hashes, None)
    m = max(1, len(words))
    trie = Trie(words, [], [], [])
    place, can = np.zeros(len(hashes), dtype=np.int64), np.ones(len(hashes), dtype=bool)
    for k in range(depth):
        if k:
            can = can[:-1] & joined[k:]
        at = np.flatnonzero(can)
        keys, counts, own = _summed(place[at] * m + label[at + k], None)
        place = np.zeros(len(can), dtype=np.int64)
        place[at] = own
        trie.parents.append(keys // m)
        trie.labels.append(keys % m)
        trie.counts.append(counts)
    return trie


def _found(trie: Trie, splitter: Path) -> tuple[list[int], list[int]]:
    """How many nodes of each level come before the splitter, and the places of the nodes above it that come before it."""
    m = max(1, len(trie.words))
    cuts, above, parent, exact = [], [], 0, True
    for k in range(len(trie.counts)):
        keys = trie.keys[k]
        if not exact or k >= len(splitter):  # all children of what comes before the splitter come before it
            cuts.append(int(np.searchsorted(trie.parents[k], parent)))
            parent, exact = cuts[-1], False
            continue
        label = int(np.searchsorted(trie.words, np.uint64(splitter[k])))
        known = label < len(trie.words) and int(trie.words[label]) == splitter[k]
        at = int(np.searchsorted(keys, parent * m + label))
        exact = known and at < len(keys) and int(keys[at]) == parent * m + label
        inner = exact and k + 1 < len(splitter)
        if inner:
            above.append(at)
        cuts.append(at + inner)
        parent = at
    return cuts, above


def cut(trie: Trie, splitters: list[Path]) -> list[tuple[int, bytes]]:
    """(range, serialised trie) for each range in which the trie has nodes; range k begins at splitter k - 1."""
    ends = [len(c) for c in trie.counts]
    bounds = [([0] * len(ends), [])] + [_found(trie, s) for s in splitters] + [(ends, [])]
    parts = []
    for k in range(len(bounds) - 1):
        (begin, above), end = bounds[k], bounds[k + 1][0]
        picks = [np.append(np.array(above[j : j + 1], dtype=np.int64), np.arange(begin[j], end[j])) for j in range(len(ends))]
        if any(len(p) for p in picks):
            parts.append((k, serialised(trie, picks)))
    return parts


def smallest(values: np.ndarray) -> np.ndarray:
    """The same whole numbers from 0 on in as few bytes each as their largest takes."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _lines(raw: bytes, at: int, length: int, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8, count=width * length, offset=at).reshape(width, length)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def packed(rising: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value: rising 64-bit numbers as differences, other whole numbers as they are; like bytes of an array stand together."""
    fields, heads = [], [len(rising), len(numbers)]
    for values in rising:
        heads.append(len(values))
        fields.append(_planes(np.diff(values, prepend=np.uint64(0))))
    for values in numbers:
        heads += [len(values), values.itemsize]
        fields.append(_planes(values))
    return zstandard.ZstdCompressor(level=1).compress(np.array(heads, dtype=np.int64).tobytes() + b"".join(fields))


def unpacked(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What ``packed`` was given; whole numbers come in 64 bits."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, more = (int(v) for v in np.frombuffer(raw, dtype=np.int64, count=2))
    heads = [int(v) for v in np.frombuffer(raw, dtype=np.int64, count=2 + n + 2 * more)[2:]]
    at, rising, numbers = 8 * (2 + len(heads)), [], []
    for length in heads[:n]:
        rising.append(np.cumsum(_lines(raw, at, length, 8), dtype=np.uint64))
        at += 8 * length
    for length, width in zip(heads[n::2], heads[n + 1 :: 2], strict=True):
        numbers.append(_lines(raw, at, length, width).astype(np.int64))
        at += length * width
    return rising, numbers


def serialised(trie: Trie, picks: list[np.ndarray]) -> bytes:
    """The picked nodes (with all nodes above them): words, then for each level labels, children of each node above and counts."""
    used = np.unique(np.concatenate([trie.labels[k][p] for k, p in enumerate(picks)]))
    numbers = []
    for k, p in enumerate(picks):
        children = np.bincount(np.searchsorted(picks[k - 1], trie.parents[k][p]), minlength=len(picks[k - 1])) if k else np.zeros(0, np.int64)
        numbers += [smallest(np.searchsorted(used, trie.labels[k][p])), smallest(children), smallest(trie.counts[k][p])]
    return packed([trie.words[used]], numbers)


def restored(data: bytes) -> Trie:
    (words,), numbers = unpacked(data)
    trie = Trie(words, [], [], [])
    for k in range(len(numbers) // 3):
        labels, children, counts = numbers[3 * k : 3 * k + 3]
        trie.parents.append(np.repeat(np.arange(len(children)), children) if k else np.zeros(len(labels), dtype=np.int64))
        trie.labels.append(labels)
        trie.counts.append(counts)
    return trie


def merged(blobs: list[bytes]) -> Trie:
    """The sum of tries of one range: a merge of their sorted levels, from the top down."""
    tries = [restored(b) for b in blobs]
    words = np.unique(np.concatenate([t.words for t in tries]))
    m, depth = max(1, len(words)), len(tries[0].counts)
    places = [np.zeros(1, dtype=np.int64) for _ in tries]
    names = [np.searchsorted(words, t.words) for t in tries]
    out = Trie(words, [], [], [])
    for k in range(depth):
        keys = np.concatenate([places[i][t.parents[k]] * m + names[i][t.labels[k]] for i, t in enumerate(tries)])
        found, sums, place = _summed(keys, np.concatenate([t.counts[k] for t in tries]))
        out.parents.append(found // m)
        out.labels.append(found % m)
        out.counts.append(sums)
        places = np.split(place, np.cumsum([len(t.counts[k]) for t in tries])[:-1])
    return out


def walked(trie: Trie, first: Path, least: int):
    """For each level (paths, counts, counts of each node's prefixes) of the nodes that occur ``least`` times and don't come before ``first``.

    Paths and prefixes are arrays with a column for each word and each prefix, the shortest first.
    """
    paths = np.zeros((1, 0), dtype=np.uint64)
    lefts = np.zeros((1, 0), dtype=np.int64)
    begins = _found(trie, first)[0] if first else [0] * len(trie.counts)
    for k, counts in enumerate(trie.counts):
        parents = trie.parents[k]
        paths = np.concatenate([paths[parents], trie.words[trie.labels[k]][:, None]], axis=1)
        lefts = lefts[parents]
        kept = (counts >= least) & (np.arange(len(counts)) >= begins[k])
        yield paths[kept], counts[kept], lefts[kept]
        lefts = np.concatenate([lefts, counts[:, None]], axis=1)


def owned(trie: Trie, first: Path) -> int:
    """The sum of the counts of the words whose node lies in the range that begins at ``first``."""
    return int(trie.counts[0][_found(trie, first)[0][0] if first else 0 :].sum())
