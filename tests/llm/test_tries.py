"""Count tries cut at any splitters and merged again, and phrases mined from odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st

from tidemark.llm import collocations as mining
from tidemark.llm.collocations import collocations
from tidemark.llm.tries import built, cut, merged, owned, walked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
runs = st.lists(st.lists(st.integers(1, 6), max_size=12), min_size=1, max_size=4)


def flat(pieces):
    words = np.array([w for p in pieces for w in p], dtype=np.uint64)
    joined = np.array([k > 0 for p in pieces for k in range(len(p))], dtype=bool)
    return words, joined


@given(st.lists(runs, min_size=1, max_size=4), st.lists(st.lists(st.integers(1, 7), min_size=1, max_size=3).map(tuple), max_size=5))
@examples(max_examples=200, deadline=None)
def test_ranges_of_merged_tries_count_every_path_once_and_know_its_prefixes(shards, splitters):
    splitters = sorted(set(splitters))
    want = Counter(tuple(p[i : i + k]) for s in shards for p in s for k in (1, 2, 3) for i in range(len(p) - k + 1))
    parts = {}
    for s in shards:
        for k, blob in cut(built(*flat(s), 3), splitters):
            parts.setdefault(k, []).append(blob)
    got, total = {}, 0
    for k, blobs in parts.items():
        first = splitters[k - 1] if k else ()
        trie = merged(blobs)
        total += owned(trie, first)
        for paths, counts, lefts in walked(trie, first, 1):
            for path, n, before in zip(paths.tolist(), counts.tolist(), lefts.tolist(), strict=True):
                assert tuple(path) not in got and tuple(path) >= first and (k == len(splitters) or tuple(path) < splitters[k])
                got[tuple(path)] = n
                assert before == [want[tuple(path[:j])] for j in range(1, len(path))]
    assert got == want and total == sum(n for p, n in want.items() if len(p) == 1)


def brute(rows, least, top=2000, longest=3):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f = Counter()
        for _, text, own, _ in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in c.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        kept = []
        for p, a in c.items():
            if 100 * around[p] < 50 * a:
                score, _, left, right = min((10**6 * a * a // (f[p[:j]] * f[p[j:]]), j, f[p[:j]], f[p[j:]]) for j in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize(("nodes", "shard", "longest"), [(3_000_000, 2_000_000, 3), (2000, 3000, 3), (500, 1, 4)])
def test_collocations_of_odd_rows(spark, odd_docs, no_docs, monkeypatch, nodes, shard, longest):
    monkeypatch.setattr(mining, "RATE", 1000 if nodes > 1000 else 20)
    rows = [(r["doc_id"], r["text"], r["lang"], None) for r in odd_docs.collect()]
    got = sorted(tuple(r) for r in collocations(odd_docs, least=2, top=300, nodes=nodes, shard=shard, longest=longest).collect())
    assert got == brute(rows, 2, 300, longest)
    assert collocations(no_docs).collect() == []
