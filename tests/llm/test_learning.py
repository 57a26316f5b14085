"""Classifiers by held-out accuracy, mixing by its marginals, filters and formats by plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF, rows_of, sql_rows
from tidemark.llm import mixing, queries
from tidemark.llm.common import table
from tidemark.llm.preferences import format_preferences, swapped_pairs
from tidemark.llm.quality import estimate_prior, fit, quality, sigmoid
from tidemark.llm.text_features import ABUSE, TOXIC_FEATURES, WORD, toxic_features
from tidemark.llm.toxicity import FOLDS, lexicons, toxicity
from tidemark.llm.url_filter import Digests, Rule, digest, judge, write_digests

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns, want = sql_rows(duck, queries.ORACLES[name])
    assert sorted(df.columns) == columns and rows_of(df) == want


# ---------------------------------------------------------------------------------------------- classifiers
def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def held_out(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    kept = [(r.score, r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return tuple(np.array(x) for x in zip(*kept, strict=True))


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op6_toxicity(spark, SMALL).collect()
    score, predicted, label = held_out(rows, table(spark, SMALL, "labels"), "toxic")
    assert auc(score, label) > 0.9 and (predicted[label == 0] == 0).mean() > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows) and len(rows) == table(spark, SMALL, "documents").count()


def test_abuse_is_caught_on_held_out_rows(spark):
    """All held-out toxic texts that hold a word of abuse, which some labels of these tables don't, and few others."""
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    toxic = {r.doc_id for r in table(spark, SMALL, "labels").where("toxic = 1").collect()}
    rows = [r for r in queries.op6_toxicity(spark, SMALL).collect() if r.held_out]
    abusive = {r.doc_id for r in rows if r.doc_id in toxic and ABUSE & set(WORD.findall((docs[r.doc_id] or "").lower()))}
    assert len(abusive) > 10 and all(r.predicted for r in rows if r.doc_id in abusive)


def test_disguised_words():
    place = {n: k for k, n in enumerate(TOXIC_FEATURES)}
    for text in ("you are an id!ot", "you are $tupid", "you are st@pid", "you 1d1ot"):
        got = toxic_features(text, {"stapid": 3.0})
        assert got[place["disguised_count"]] == 1 and got[place["near_second"]] > 0, text
    plain = toxic_features("a|b c! $5 x@y.z you!", {})
    assert plain[place["disguised_count"]] == plain[place["abuse_count"]] == 0


def test_lexicons_leave_their_own_part_out(spark):
    rows = [(k % FOLDS, int(k % 2), f"word{k} " + ("vile " if k % 2 else "fine ") + ("only0 only0 only0" if k % FOLDS == 0 and k % 2 else "")) for k in range(200)]
    made = lexicons(spark.createDataFrame(rows, "part int, label int, text string"))
    assert len(made) == FOLDS + 1 and all("vile" in x and "fine" not in x for x in made)
    assert "only0" in made[FOLDS] and "only0" not in made[0]


def test_quality_on_held_out_rows(spark):
    rows = queries.op10_quality(spark, SMALL).collect()
    score, predicted, label = held_out(rows, table(spark, SMALL, "labels"), "quality")
    assert auc(score, label) > 0.9 and (predicted[label == 1] == 1).mean() > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_of_odd_rows(spark, odd_docs, no_docs, operator):
    labels = table(spark, SF, "labels")
    got = operator(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert got[0].row.asDict().keys() == set(odd_docs.columns)
    assert len({r.score for r in got if r.row.doc_id == 6}) == 1
    assert operator(no_docs, labels).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert operator(odd_docs, odd).count() == odd_docs.count() and operator(odd_docs, odd.where("false")).count() == odd_docs.count()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    for operator, column, divisor, fold in ((toxicity, "toxic", 3, 1), (quality, "quality", 4, 2)):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == fold
        turned = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        key = lambda df: {r.row.doc_id: round(r.score, 6) for r in df.collect()}
        assert key(operator(docs, labels)) == key(operator(docs, turned))


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (6000, 3)), rng.normal(-1.5, 1, (1200, 3))
    positive, unlabelled = good[:3000], np.concatenate([good[3000:], bad])
    prior = estimate_prior(positive, unlabelled)
    assert abs(prior - 3000 / 4200) < 0.08
    net = fit(positive, unlabelled, prior, 1)
    assert sigmoid(net.forward(rng.normal(1.5, 1, (500, 3)))[1]).mean() > 0.9 and sigmoid(net.forward(rng.normal(-1.5, 1, (500, 3)))[1]).mean() < 0.2


# ---------------------------------------------------------------------------------------------- mixing
def test_marginals_meet_targets(spark):
    docs = table(spark, SMALL, "documents")
    targets = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    rows = mixing.mixed(docs, targets).toPandas()
    share = (rows["n_tokens"] * rows["weight"]).groupby(rows["lang"]).sum() / rows["n_tokens"].sum()
    assert {k: round(v, 4) for k, v in share.items()} == targets["lang"]
    by_source = rows.groupby("source")["n_tokens"].sum() ** 0.5
    share = (rows["n_tokens"] * rows["weight"]).groupby(rows["source"]).sum() / rows["n_tokens"].sum()
    assert np.allclose(share, by_source / by_source.sum(), atol=1e-3)
    expected = (rows["n_tokens"] * rows["probability"]).sum() / rows["n_tokens"].sum()
    assert abs(expected - mixing.BUDGET) < 1e-6 and abs(rows.loc[rows["sampled"], "n_tokens"].sum() / rows["n_tokens"].sum() - mixing.BUDGET) < 0.1


@pytest.mark.parametrize("budget", [0.25, mixing.BUDGET])
def test_marginals_of_probabilities_meet_targets(spark, budget):
    """At 0.25 every default target can be met; at the default budget some values have fewer tokens than their share and keep all."""
    rows = mixing.mixed(table(spark, SMALL, "documents"), budget=budget).where("n_tokens > 0").toPandas()
    total = rows["n_tokens"].sum()
    assert (rows["probability"] <= 1).all() and abs((rows["n_tokens"] * rows["probability"]).sum() / total - budget) < 1e-6
    for name in mixing.DIMENSIONS:
        have = rows.groupby(name)["n_tokens"].sum().sort_index()
        target = have**0.5 / (have**0.5).sum()
        got = (rows["n_tokens"] * rows["probability"]).groupby(rows[name]).sum().sort_index() / (budget * total)
        share = have / (budget * total)
        scarce = share < target
        while (share[scarce] < (more := target / target[~scarce].sum() * (1 - share[scarce].sum()))[scarce]).all() and (new := scarce | (share < more)).sum() > scarce.sum():
            scarce = new
        want = share.where(scarce, target / target[~scarce].sum() * (1 - share[scarce].sum()))
        assert np.allclose(got, want, atol=1e-6 if budget < mixing.BUDGET else 1e-3) and (budget == mixing.BUDGET or not scarce.any())


def test_raking_under_a_ceiling():
    weights, places = np.array([10.0, 90.0, 50.0, 50.0]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    targets = [np.array([0.5, 0.5]), np.array([0.5, 0.5])]
    wants = [mixing.attainable(np.bincount(p, weights), t, 100.0) for p, t in zip(places, targets, strict=True)]
    chance = mixing.probabilities(weights, mixing.rake(weights, places, targets), places, wants)
    assert chance[0] == 1 and all(np.allclose(np.bincount(p, weights * chance), [50, 50], atol=1e-3) for p in places)
    assert mixing.attainable(np.array([10.0, 100.0, 100.0]), np.array([0.5, 0.25, 0.25]), 100.0).tolist() == [10, 45, 45]


def test_raking_by_aggregation_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    docs = table(spark, SF, "documents")
    targets = {"lang": {"en": 0.5, "de": 0.5}, "source": {"src0": 0.7, "src1": 0.3, "none": 0.1}}
    key = lambda df: {r.row.doc_id: (round(r.weight, 6), round(r.probability, 6), r.sampled) for r in df.collect()}
    assert key(mixing.mixed(docs, targets)) == key(mixing.mixed(docs, targets, max_cells=0))


def test_what_is_not_met_is_told(spark, monkeypatch):
    """At 0.25 all default targets can be met, see above; after one round they aren't yet."""
    told = lambda sf, **more: {r.met for r in mixing.mixed(table(spark, sf, "documents"), **more).select("met").distinct().collect()}
    assert told(SMALL, budget=0.25) == {True}
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    assert told(SF, budget=0.25) == told(SF, budget=0.25, max_cells=0) == {False}
    assert told(SF, targets={"lang": {"none": 1.0}}, max_cells=0) == {False}


def test_mixing_odd_rows(odd_docs, no_docs):
    got = mixing.mixed(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.source for r in got} == {"a", "b", "c", "(none)"}
    assert not any(r.sampled for r in got if r.n_tokens == 0) and mixing.mixed(no_docs).count() == 0
    assert len({r.sampled for r in got if r.row.doc_id == 6}) == 1


# ---------------------------------------------------------------------------------------------- urls
def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best.host + best.path if best else None, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/", "https://example.com/en", "http://xexample.com/en/1", "x://net/fr/", "x://a.b.net/es/?q", "http://com",
    "http://com/", "http://é.com/ü", "a://b://c.com/en/", "http://example.org/#/com/", "http://u:p@Example.com:80/en/", "http://.com/", "http://a..com/",
    "http://" + "a." * 50_000 + "net/es/" + "b/" * 50_000, "http://net./es/", "http://www.example.com.net/fr/",
]


@pytest.mark.parametrize("max_file", [1 << 20, 0])
def test_urls(spark, max_file):
    rows = [(k, u, "h", "p") for k, u in enumerate(URLS)] + [(4, URLS[4], None, None), (None, URLS[5], None, None)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), queries.URL_RULES, max_file=max_file).collect()
    want = [(k, *plain_judge(u, queries.URL_RULES)) for k, u, _, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES, max_file=max_file).count() == 0
    assert judge(spark.createDataFrame(rows[:3], "page_id long, url string, host string, rule string"), [], max_file=max_file).count() == 3


@pytest.mark.parametrize("max_file", [1 << 20, 2000, 0])
def test_urls_against_a_table_of_rules(spark, max_file):
    made = [Rule(f"h{k % 300}.example{'.org' if k % 2 else '.com'}", "/" * (k % 2) + "a" * (k % 7), "block" if k % 3 else "allow") for k in range(2000)]
    first = {}
    for rule in sorted(made, key=lambda r: r.verdict):
        first.setdefault(rule.host + rule.path, rule)
    rows = [(k, f"http://www.h{k % 400}.example{'.com' if k % 5 else '.org'}{'/' * (k % 3 > 0)}{'a' * (k % 9)}?q") for k in range(3000)] + [(7, None)]
    rules = spark.createDataFrame([*made, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string").repartition(3)
    got = judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules, max_file=max_file).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, *plain_judge(u, first.values())) for k, u in rows), key=repr)
    assert {r.verdict for r in got if r.rule} == {"allow", "block"}
    assert {r.rule for r in judge(spark.createDataFrame(rows[:3], "page_id long, url string"), rules.where("false"), max_file=max_file).collect()} == {None}


def test_colliding_keys_are_told_apart(tmp_path):
    rules = [Rule(f"h{k}.com", "/", "block") for k in range(300)] + [Rule("h7.com", "/", "allow")]
    place = tmp_path / "digests"
    place.write_bytes(write_digests(rules))
    found = Digests(str(place))
    assert len(found.keys) == 300 and (np.diff(found.keys.astype(np.float64)) >= 0).all()
    for text, listed in (("h3.com/", True), ("h3.com", False), ("", False)):
        key = np.uint64(digest(text))
        assert bool(found.probe(np.array([key]))[0]) is listed
    key = np.uint64(digest("h3.com/"))
    assert found.string(found.confirm(key, "h3.com/")) == "h3.com/" and found.confirm(key, "another string") == -1


# ---------------------------------------------------------------------------------------------- preferences
def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "and?"), (1, 0, "user", "hm"), (1, 1, "assistant", "no"), (2, 0, "user", None), (2, 1, "assistant", ""), (4, 0, "user", "alone"),
        (None, 0, "user", "lost"), (None, 0, "user", "lost"), (6, 0, "assistant", "same"), (7, 0, "assistant", "same"), (8, 0, None, None), (8, None, "assistant", "x" * 50000), (8, 0, None, None),
    ]
    df = spark.createDataFrame([(*r, "c", "r") for r in rows], "conv_id long, turn long, role string, text string, chosen string, rejected string")
    got = {r.id: r for r in format_preferences(swapped_pairs(df)).collect() if r.id is not None}
    zero = got[0]
    assert zero.prompt == "<|user|>\nhi<|end|>\n" and zero.chosen == "<|assistant|>\nyo<|end|>\n" and zero.rejected == "<|assistant|>\nno<|end|>\n" and zero.prefix_turns == 1
    assert [zero.chosen[s.start : s.stop] for s in zero.chosen_spans] == ["yo<|end|>\n"] and [zero.rejected[s.start : s.stop] for s in zero.rejected_spans] == ["no<|end|>\n"]
    assert got[2].rejected is None and got[2].prompt == "<|user|>\n<|end|>\n"
    assert got[4].prompt == "" and got[4].chosen == "<|user|>\nalone<|end|>\n" and got[4].chosen_spans == []
    assert got[6].chosen == got[6].rejected == "" and got[6].prefix_turns == 1
    assert format_preferences(swapped_pairs(df)).where("id is null").count() == 2
    assert format_preferences(swapped_pairs(df.where("false"))).count() == 0


# ---------------------------------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, SMALL).cache()
        if name != "packing":
            assert out.columns == docs.columns and out.count() < left.count()
            assert out.join(left.select("doc_id", "text"), ["doc_id", "text"], "left_anti").isEmpty()
        else:
            assert out.select("doc_id").distinct().count() == left.count()
        left = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicate_stage_keeps_every_text(spark):
    """Rows are told apart though they share an id: a text goes only if one like it stays."""
    w, u, t = (" ".join(f"{c}{k}" for k in range(40)) for c in "wut")
    rows = [(1, w), (5, w), (5, u), (6, u + " z"), (7, t), (7, t), (None, t + " y"), (None, "a b c"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0, "n") for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(left, key=repr) == sorted([(1, w), (left[[x in (u, u + " z") for _, x in left].index(True)]), (7, t), (None, "a b c"), (8, None), (8, None)], key=repr)


def test_stages_without_labels_keep_all_rows(spark, odd_docs, tmp_path):
    table(spark, SF, "labels").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_good):
        assert stage(spark, odd_docs, str(tmp_path)).count() == odd_docs.count()


def test_pipeline_stages_of_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd_docs, SF), stage(spark, no_docs, SF)
        assert none.count() == 0 and none.columns == got.columns
        if name != "packing":
            assert got.columns == odd_docs.columns and got.exceptAll(odd_docs).isEmpty()
        else:
            assert got.where("start = 0").count() == odd_docs.count()
