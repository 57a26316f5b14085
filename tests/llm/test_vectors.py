"""Vector codes against a search over all entries, and odd rows."""

import hashlib

import numpy as np
from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st

from tidemark.llm.vector_codes import Codebook, vector_codes


@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=16), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=20), st.integers(0, 2**40))
@examples(max_examples=150, deadline=None)
def test_search_finds_the_lowest_nearest_entry_from_any_start(entries, points, factor):
    scaled = [[v * (factor or 1) for v in e] for e in entries]
    x = np.array([[v * (factor or 1) for v in p] for p in points], dtype=np.int64)
    start = np.arange(len(points)) % len(entries)
    best, d = Codebook(scaled).nearest(x, start)
    for k, p in enumerate(x.tolist()):
        all_d = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in scaled]
        assert (best[k], d[k]) == (all_d.index(min(all_d)), min(all_d))


def brute(rows, width, rounds=6):
    kept = sorted(((i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // 8
    cut = [[v[p * w : (p + 1) * w] for p in range(8)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:16]] for p in range(8)]

    def assign():
        out = []
        for c in cut:
            row = []
            for p in range(8):
                d = [sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p][0] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = assign()
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    sums = {}
    for (_, _, label), g in zip(kept, got, strict=True):
        sums[label] = sums.get(label, 0) + sum(d for _, d in g)
    return sorted(((i, "".join(f"{k:02x}" for k, _ in g), sum(d for _, d in g), sums[label], sha) for (i, _, label), g in zip(kept, got, strict=True)), key=repr)


def test_vector_codes_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)], int(i) % 3 or None) for i in rng.permutation(60)]
    rows += [(7, rows[0][1], 1), (7, rows[0][1], 1), (None, rows[1][1], 2), (1000, [30000.5] * 16, 2), (1001, [-5e6] * 8 + [0.0] * 8, None)]
    odd = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 2), (503, [float("inf")] + [0.0] * 15, 2), (504, [], 1), (505, [1.0] * 8, 1), (506, [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, code string, part int").repartition(5)
    got = sorted((tuple(r) for r in vector_codes(df).collect()), key=repr)
    assert got == brute(rows, 16)
    assert vector_codes(df.where("false")).collect() == []
    few = vector_codes(df.where("vec_id in (1, 2)")).collect()
    assert sorted(r["error"] for r in few) == [0, 0]
