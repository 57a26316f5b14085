"""Document fingerprints: Merkle trees over sections, paragraphs and their sentences.

A leaf is a sentence, or a piece of one: it ends after ". ", "! " or "? ", else where two characters in a row say so, else at the last space
within its bound, else at its bound, so no text is a single long leaf. A paragraph is a line, or a run of leaves of a long one that ends where a
leaf's digest says so; its node is the digest of its leaves. A section is a run of paragraphs that ends where a paragraph's digest says so, and so on
upwards. So an edit moves few boundaries but its own. All runs are bounded too, as all leaves of repeating text are alike. The root is the digest of the sections.

The fingerprint is a string: the root, then the nodes of one depth, from which every node above can be rebuilt. Texts of up to ``LISTED`` leaves
list these, ``root|leaf.leaf leaf ...;...``; longer ones list paragraphs, sections or runs of those with their numbers of leaves, ``root|depth:node*leaves ...``, so
a fingerprint is bounded however long its text. Equal roots mean equal texts. Likeness walks two trees from the top: nodes that are equal and in order count whole,
and only what lies between them is compared one depth further down.

Texts with their successors by id come from one range shuffle; the seams between partitions are mended from two rows of
each. Nulls, ties and odd rows: a null text is empty and has a root of its own; null ids come first; rows with
one id follow each other by the hash of their text; a table of one row is its own successor; a very long text is read whole and has a fingerprint of
coarser nodes. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle, small_batches

#: A section ends at a paragraph whose digest is a multiple of this, a paragraph within a line at such a leaf; and at so many of them at most.
SECTION, PARAGRAPH = 4, 8
MOST_PARAGRAPHS, MOST_LEAVES = 32, 16
#: The least and most characters of a line's first leaf, which is short so that short texts have several, and of the others.
FIRST, OTHERS = (12, 24), (32, 64)
#: Hexadecimal digits of a leaf and of any other node but the root.
LEAF = 6
#: The most nodes that a fingerprint lists.
LISTED = 1024


def _digest(parts: list[str]) -> str:
    return hashlib.blake2b("\n".join(parts).encode(), digest_size=16).hexdigest()


class Node(NamedTuple):
    digest: str
    leaves: int
    below: tuple


def _node(below: list[Node]) -> Node:
    return Node(_digest([x.digest for x in below])[:LEAF], sum(x.leaves for x in below), tuple(below))


def _runs(nodes: list[Node]) -> list[Node]:
    """The nodes one depth above paragraphs or higher: runs that end where a digest says so."""
    made, run = [], []
    for node in nodes:
        run.append(node)
        if int(node.digest, 16) % SECTION == 0 or len(run) >= MOST_PARAGRAPHS:
            made.append(_node(run))
            run = []
    return made + [_node(run)] if run else made


def _class(k: int) -> str:
    """A quarter of all characters but spaces, by a hash."""
    return "".join(re.escape(chr(c)) for c in range(0x21, 0xD800) if not chr(c).isspace() and (c * 2654435761 >> 20) % 4 == k)


def _cutter(least: int, most: int) -> re.Pattern:
    pair = f"[{_class(0)}][{_class(1)}]"
    return re.compile(f".{{10,{most - 2}}}?[.!?] |.{{{least - 2},{most - 2}}}?{pair}|.{{{least - 1},{most - 1}}} |.{{1,{most}}}", re.DOTALL)


_FIRST, _OTHERS = _cutter(*FIRST), _cutter(*OTHERS)


def pieces(line: str) -> list[str]:
    """The leaves of a line as texts; together they are the line."""
    if len(line) <= FIRST[1]:
        return [line]
    end = _FIRST.match(line).end()
    return [line[:end], *_OTHERS.findall(line, end)]


def _paragraphs(text: str | None) -> list[Node]:
    found: list[Node] = []
    for line in (text or "").split("\n"):
        run: list[Node] = []
        for piece in pieces(line):
            leaf = xxhash.xxh3_64_hexdigest(piece.encode())[:LEAF]
            run.append(Node(leaf, 1, ()))
            if int(leaf, 16) % PARAGRAPH == 0 or len(run) >= MOST_LEAVES:
                found.append(_node(run))
                run = []
        if run:
            found.append(_node(run))
    return found


def tree(text: str | None) -> list[list[list[str]]]:
    """Leaf digests by section and paragraph."""
    return [[[leaf.digest for leaf in p.below] for p in section.below] for section in _runs(_paragraphs(text))]


def fingerprint(text: str | None) -> str:
    """The tree as a string. The root also covers the whole text, so equal roots mean equal texts."""
    nodes = _paragraphs(text)
    sections = _runs(nodes)
    root = _digest([*(s.digest for s in sections), xxhash.xxh3_128_hexdigest((text or "").encode())])
    if sum(p.leaves for p in nodes) <= LISTED:
        return root + "|" + ";".join(" ".join(".".join(leaf.digest for leaf in p.below) for p in s.below) for s in sections)
    depth = 1
    while len(nodes) > LISTED:
        nodes, depth = _runs(nodes), depth + 1
    return f"{root}|{depth}:" + " ".join(f"{x.digest}*{x.leaves}" for x in nodes)


def _read(mark: str) -> tuple[int, list[Node]]:
    """The depth that a fingerprint lists, 0 for leaves, and its nodes there; those of paragraphs for leaves."""
    listed = mark.partition("|")[2]
    if ":" not in listed:
        return 0, [_node([Node(leaf, 1, ()) for leaf in p.split(".")]) for p in listed.replace(";", " ").split(" ")]
    depth, _, nodes = listed.partition(":")
    return int(depth), [Node(x[:LEAF], int(x[LEAF + 1 :]), ()) for x in nodes.split(" ")]


def _in_order(one: list[Node], two: list[Node]) -> list[tuple[int, int]]:
    """Places of equal nodes in both, rising in both: the common start and end, and between them the longest rising run of the places of the same occurrence."""
    first, most = 0, min(len(one), len(two))
    while first < most and one[first].digest == two[first].digest:
        first += 1
    last = 0
    while last < most - first and one[-1 - last].digest == two[-1 - last].digest:
        last += 1
    places = defaultdict(deque)
    for j in range(first, len(two) - last):
        places[two[j].digest].append(j)
    pairs = [(i, places[one[i].digest].popleft()) for i in range(first, len(one) - last) if places.get(one[i].digest)]
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        d = bisect_left(ends, j)
        before.append(at[d - 1] if d else -1)
        if d == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[d], at[d] = j, k
    found = []
    k = at[-1] if at else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return [*((k, k) for k in range(first)), *found[::-1], *((len(one) - k, len(two) - k) for k in range(last, 0, -1))]


def _shared(one: list[Node], two: list[Node], steps: int) -> int:
    """Leaves of equal nodes in order, going down ``steps`` depths where they differ."""
    total = i = j = 0
    for a, b in [*_in_order(one, two), (len(one), len(two))]:
        if steps and i < a and j < b:
            total += _shared([x for n in one[i:a] for x in n.below], [x for n in two[j:b] for x in n.below], steps - 1)
        if a < len(one):
            total += one[a].leaves
        i, j = a + 1, b + 1
    return total


def likeness(one: str, two: str) -> float:
    """The share of leaves that two trees have in common and in order, 1 for equal roots."""
    if one.partition("|")[0] == two.partition("|")[0]:
        return 1.0
    (depth, a), (other, b) = _read(one), _read(two)
    steps = 0 if max(depth, other) else 1  # lists of leaves are read as paragraphs
    depth, other = max(depth, 1), max(other, 1)
    while depth != other:
        if depth < other:
            a, depth = _runs(a), depth + 1
        else:
            b, other = _runs(b), other + 1
    while max(len(a), len(b)) > SECTION:
        a, b, steps = _runs(a), _runs(b), steps + 1
    all_leaves = sum(x.leaves for x in (*a, *b))
    return min(2.0 * _shared(a, b, steps) / all_leaves, 1 - 1e-9)


def _sections(mark: str) -> list[str]:
    depth, nodes = _read(mark)
    return [x.digest for x in (_runs(nodes) if depth < 2 else nodes)]


def differing_sections(one: str, two: str) -> list[int]:
    """The places of the sections of ``one`` that ``two`` doesn't hold: where the texts differ."""
    theirs = Counter(_sections(two))
    found = []
    for place, section in enumerate(_sections(one)):
        if theirs[section]:
            theirs[section] -= 1
        else:
            found.append(place)
    return found


def spliced(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(text: str, mark: str, following: str, next_mark: str) -> tuple:
    edited = spliced(text, following)
    edited_mark = fingerprint(edited)
    return hashlib.sha256(edited.encode()).hexdigest(), edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)


ROWS = "part int, doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double, head boolean, tail boolean, text string"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to rows compared with their successors. A partition's first and last rows keep their texts."""
    part = TaskContext.get().partitionId()
    last = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            mark = fingerprint(text)
            if last is not None:
                i, t, m, head = last
                out.append((part, i, len(t), m, *_compared(t, m, text, mark), head, False, t if head else None))
            last = doc_id, text, mark, last is None
        yield _batch(out)
    if last is not None:
        i, t, m, head = last
        yield _batch([(part, i, len(t), m, None, None, None, None, head, True, t)])


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["doc_id"], r["n_chars"], r["fingerprint"], *_compared(r["text"], r["fingerprint"], r["next_text"], r["next_mark"])) for r in batch.to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS[1:8], strict=True)], names=_NAMES[1:8])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its spliced text, and its likeness to both the spliced text and the next row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    walked = settle(ordered.mapInArrow(_walk, ROWS), "fingerprints")
    # One row for each partition that has any, so the window is over at most as many rows as there are partitions.
    heads = walked.where("head").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    order = Window.orderBy("part")
    parts = walked.where("head").select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    seams = walked.where("tail").select("part", "doc_id", "n_chars", "fingerprint", "text").join(parts, "part")
    seams = seams.join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "n_chars", "fingerprint", "text", "next_text", "next_mark")
    columns = _NAMES[1:8]
    mended = seams.mapInArrow(_mend, ", ".join(ROWS.split(", ")[1:8]))
    rows = walked.where("not tail").select(*columns).unionByName(mended.select(*columns))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
