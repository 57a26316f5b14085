"""Parts of a report on small tables."""

import json

from pyspark.sql import functions as F

from tidemark.operators import explore, network, repositories
from tidemark.plans import report

RUNS = "run_id long, status string, roots array<string>, repositories_found int"


def test_meta(spark):
    runs = spark.createDataFrame([(1, "complete", ["/x"], 1), (3, "partial", ["/a", "/b"], 2), (2, "failed", None, 0)], RUNS)
    one = report.meta(runs).first()
    assert (one.roots, one.run.run_id, one.run.status, one.run.started_at) == (["Root 1", "Root 2"], 3, "partial", None)
    assert json.loads(one.history)["scope"] == "local" and json.loads(one.report)["top_n"] == 15
    assert report.meta(runs, {"privacy": {"include_absolute_paths": True}}).first().roots == ["/a", "/b"]
    none = report.meta(runs.where("false")).first()
    assert none.roots == [] and none.run.run_id is None


def test_contents_of_repositories_without_any(spark):
    rows = spark.createDataFrame([(1,), (2,)], "repo_id long")
    tree = spark.createDataFrame([(1, "B", 2, 9), (1, "A", 1, 9), (1, "C", 1, 20)], "repo_id long, language string, files long, bytes long")
    stats = spark.createDataFrame(
        [(1, "A", "all", 1, 6, 2, 1), (1, "A", "line", 0, 0, 2, 0)], "repo_id long, language string, kind string, files long, code_lines long, comment_lines long, blank_lines long"
    )
    types = spark.createDataFrame([(1, ".a", 1, 5)], "repo_id long, file_type string, files long, bytes long")
    made = repositories.with_contents(rows, tree, stats, types)
    one, two = made.orderBy("repo_id").collect()
    assert [x.language for x in one.languages] == ["C", "A", "B"] and one.languages[1].comment_types == {"line": 2} and one.languages[0].comment_types == {}
    assert (one.code_lines, one.comment_lines, one.comment_density, one.tree_files, one.top_language) == (6, 2, 0.25, 4, "C")
    assert (two.languages, two.file_types, two.ci_systems, two.code_lines, two.comment_density, two.top_language) == ([], [], [], 0, None, None)
    assert [r.repo_id for r in explore.filter_repositories(made, file_types=[".a"]).collect()] == [1]
    assert [tuple(r) for r in explore.merged_kinds(made).collect()] == [("line", 2)]
    languages = {r.language: r for r in explore.filtered_languages(made).collect()}
    assert languages["A"].comment_types == {"line": 2} and languages["B"].comment_types == {} and languages["A"].blank_lines == 1
    assert repositories.with_contents(rows).select(F.size("languages").alias("n")).distinct().collect()[0].n == 0


def test_network_switched_off(spark):
    one = network.no_stats(spark).first()
    assert (one.enabled, one.authors, one.max_distance, one.truncated) == (False, 0, None, False)


def test_a_network_that_is_off_has_all_its_parts(spark):
    from tidemark import queries
    from tidemark.plans import report

    tables = queries.tables(spark, "/root/testdata/sf0.001")
    at = F.lit("2024-01-31").cast("date")
    off = report.build(tables, at, {"network": {"enabled": False, "reference_names": ["User 1"]}})
    on = report.build(tables, at, {"network": {"enabled": True, "reference_names": ["user 9"], "require_remote_reference": False}})
    for name in ("network_authors", "network_pairs", "network_stats", "network_model"):
        assert [f.name for f in off[name].schema] == [f.name for f in on[name].schema] or set(off[name].columns) >= set(on[name].columns), name
    one = off["network_model"].first()
    assert (one.enabled, one.reference_names, one.references_found, one.model.enabled) == (False, ["User 1"], [], False)
    assert off["network_authors"].count() == off["network_pairs"].count() == 0
    assert on["network_model"].first().references_found in (["User 9"], [])
