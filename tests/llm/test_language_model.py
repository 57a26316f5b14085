"""The backoff automaton against the plain recursion over dictionaries, and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm.common import table
from tidemark.llm.language_model import PRIOR, model_scores

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def held(i):
    return True if i is None else zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """p(w | h) by its definition."""

    def __init__(self, texts, order):
        self.order, self.c = order, Counter()
        for t in texts:
            seq = ["\t", *tokens(t)]
            for k in range(1, order + 1):
                self.c.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
        self.n = sum(c for g, c in self.c.items() if len(g) == 1 and g != ("\t",))
        self.v = sum(1 for g in self.c if len(g) == 1 and g != ("\t",))

    def p(self, w, h):
        if not h:
            return (self.c[(w,)] + 1) / (self.n + self.v + 1)
        if not self.c[h]:
            return self.p(w, h[1:])
        m = PRIOR[len(h) - 1]
        return (self.c[(*h, w)] + m * self.p(w, h[1:])) / (self.c[h] + m)

    def row(self, i, text):
        seq = tokens(text)
        base = sum(math.log10(self.p(w, ())) for w in seq)
        whole = ["\t", *seq]
        score = sum(math.log10(self.p(whole[k], tuple(whole[max(0, k - self.order + 1) : k]))) for k in range(1, len(whole)))
        return (i, held(i), len(seq), sum(self.c[(w,)] > 0 for w in seq), self.n, base, score)


def same(got, want):
    got, want = (sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])) for rows in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose(np.array([r[5:] for r in got], dtype=float), np.array([r[5:] for r in want], dtype=float), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize(("order", "block", "nodes", "piece"), [(3, 1_000_000, 4_000_000, 512), (3, 5000, 3000, 7), (2, 1, 100, 3), (4, 20_000, 50_000, 64)])
def test_scores_equal_the_recursion_on_odd_rows(spark, odd_docs, no_docs, order, block, nodes, piece):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    plain = Plain([t for i, t in rows if not held(i)], order)
    got = model_scores(odd_docs, order=order, block=block, nodes=nodes, piece=piece)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same([tuple(r) for r in got.collect()], [plain.row(i, t) for i, t in rows])
    assert model_scores(no_docs).collect() == []


def test_nothing_to_learn(spark):
    got = model_scores(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_query_equals_the_recursion_on_the_whole_table(spark):
    from tidemark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    plain = Plain([t for i, t in rows if not held(i)], 3)
    got = [tuple(r) for r in QUERIES["op11_language_model"](spark, SF).collect()]
    same(got, [plain.row(i, t) for i, t in rows])
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # contexts tell more than words alone on held-out texts


def test_probabilities_of_a_context_sum_to_one():
    plain = Plain(["a b a c", "b a", "c c a b"], 3)
    words = ["a", "b", "c", "\n", "never seen"]
    for h in [(), ("a",), ("\t", "a"), ("b", "a"), ("z", "a")]:
        assert math.isclose(sum(plain.p(w, h) for w in words), 1)
