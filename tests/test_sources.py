"""Repositories made on the spot are discovered, scanned, kept and rescanned."""

import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.config import settings
from tests.conftest import SF
from tidemark.operators import activity, code, people
from tidemark.operators.effective import effective_commits, effective_file_changes
from tidemark.plans import checks, report
from tidemark.plans.sql_surface import NotReadOnly, checked
from tidemark.sinks import files
from tidemark.sources import discovery, forge, git_history, snapshot


def run(path, *args, when="2024-01-01T09:00:00+01:00", who=("Alice Old", "alice@old.example")):
    env = os.environ | {"GIT_AUTHOR_NAME": who[0], "GIT_AUTHOR_EMAIL": who[1], "GIT_COMMITTER_NAME": who[0], "GIT_COMMITTER_EMAIL": who[1], "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    subprocess.run(["git", "-C", str(path), *args], check=True, env=env, capture_output=True)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repos")
    repo = top / "alpha"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    (repo / ".mailmap").write_text("Alice Example <alice@example.com> Alice Old <alice@old.example>\n")
    (repo / "LICENSE").write_text("MIT License\n")
    (repo / ".github/workflows").mkdir(parents=True)
    (repo / ".github/workflows/checks.yml").write_text("on: push\n")
    (repo / "app.py").write_text('# one\n"""two"""\nx = 1\ny = 2\n')
    (repo / "raw.bin").write_bytes(b"a\0b")
    run(repo, "add", "-A")
    run(repo, "commit", "-q", "-m", "feat(core): first #12")
    run(repo, "mv", "app.py", "main.py")
    bob = {"when": "2024-01-06T22:30:00+01:00", "who": ("Bob Builder", "bob@example.com")}
    run(repo, "commit", "-q", "-m", "fix!: weekend ABC-42", **bob)
    run(repo, "tag", "-a", "v1.0.0", "-m", "one", **bob)
    (top / "beta" / "node_modules" / "inner").mkdir(parents=True)
    return top


@pytest.fixture(scope="module")
def tables(spark, root):
    s = settings({"history": {"store_subjects": True}})
    places = discovery.walk([root], s["discovery"])[0]
    pairs = [(k, p[0]) for k, p in enumerate(places)]
    return s, pairs, {what: git_history.scan(spark, what, pairs, s) for what in git_history.SCHEMAS}


def test_discovery(root):
    s = settings()["discovery"]
    assert [x[2] for x in discovery.walk([root], s)[0]] == ["alpha"]
    assert discovery.inside_repository(root / "alpha" / "out") and not discovery.inside_repository(root)
    with pytest.raises(FileNotFoundError):
        discovery.walk([root / "none"], s)


def test_commits(tables):
    s, _, found = tables
    rows = git_history.commits(found["log"], s).orderBy("activity_at").collect()
    assert [(r.author_name, r.message_type, r.message_scope, r.is_breaking, r.has_issue_reference) for r in rows] == [("Alice Example", "feat", "core", False, True), ("Bob Builder", "fix", None, True, True)]
    assert [(r.activity_date, r.activity_weekday, r.activity_hour, r.timezone_offset_minutes) for r in rows] == [(dt.date(2024, 1, 1), 0, 9, 60), (dt.date(2024, 1, 6), 5, 22, 60)]
    assert [r.is_trusted for r in rows] == [False, False] and rows[0].binary_files == 1 and rows[0].insertions == 7
    changes = git_history.file_changes(found["log"])
    assert changes.where("old_path is not null").select("old_path", "path").first() == ("app.py", "main.py")
    utc = git_history.commits(found["log"], settings({"history": {"timezone": "UTC", "activity_timestamp": "committer"}})).orderBy("activity_at").first()
    assert (utc.activity_hour, utc.activity_at, utc.timezone_offset_minutes) == (8, "2024-01-01T08:00:00+00:00", 0)


def test_tree_and_signals(tables):
    _, _, found = tables
    languages, kinds = git_history.tree_tables(found["tree"])
    assert {r.language for r in languages.collect()} == {"Python", "YAML", "Other"}
    assert ".py" in {r.file_type for r in kinds.collect()}
    one = git_history.repository_signals(found["tree"], found["blobs"]).first()
    assert (one.ci_systems, one.licenses) == (["GitHub Actions"], ["MIT"])
    blobs = found["blobs"].withColumn("language", git_history.paths.language(F.col("path"))).where("language = 'Python'")
    stats = {r.kind: (r.code_lines, r.comment_lines) for r in code.comment_stats(blobs).collect()}
    assert stats == {"all": (2, 2), "line": (0, 1), "documentation": (0, 1)}
    assert found["tags"].first().name == "v1.0.0" and found["probe"].first().tags == 1
    assert "raw.bin" not in {r.path for r in found["blobs"].collect()}


def test_report_and_sinks(spark, tables, tmp_path):
    s, pairs, found = tables
    commits = git_history.commits(found["log"], s)
    repos = spark.createDataFrame([(k, "alpha", True, "ready", False, False, False, "main", "main") for k, _ in pairs],
        "repo_id long, display_name string, active boolean, status string, is_shallow boolean, is_partial boolean, is_bare boolean, head_branch string, default_branch string")
    languages, _ = git_history.tree_tables(found["tree"])
    made = report.build(report.Tables(repos, commits, git_history.file_changes(found["log"]), found["tags"], languages), F.lit("2024-02-20").cast("date"), {"network": {"enabled": True}})
    one = made["summary"].first()
    assert (one.commits, one.authors, one.breaking_changes, one.tags, one.new_authors_last_30_days, one.active_repositories) == (2, 2, 1, 1, 0, 1)
    assert made["contributors"].first()["name"] == "Alice Example"
    limits = {"failed_repositories": 0, "dormant_repositories": 0}
    assert checks.passed(checks.check(made["summary"], limits)) and not checks.passed(checks.check(made["summary"], {"commits": 1}))
    hidden = people.contributors(effective_commits(commits, repos), anonymise=True).collect()
    assert {r["name"] for r in hidden} == {"Autor 001", "Autor 002"} and {r["email"] for r in hidden} == {""}
    some = {k: made[k] for k in ("summary", "daily", "repositories", "contributors")}
    files.write_json(some, tmp_path / "r.json")
    written = files.write_csv_bundle(some, tmp_path / "csv")
    files.write_manifest(written, tmp_path / "m.json")
    assert "alpha" in files.markdown(some) and "<script" in files.html_page(some)
    assert (tmp_path / "csv/activity_daily.csv").read_text("utf-8-sig").splitlines()[0].startswith("date,commits")
    assert "</script" not in files.json_island({"a": "</script>"})
    assert files.markdown_table([{"a": "x|y\nz"}], ["a"]).endswith("| x\\|y z |")
    assert effective_file_changes(git_history.file_changes(found["log"]), commits).count() == activity.daily(effective_commits(commits, repos)).count() + 4


def test_work_trees_of_one_repository(spark):
    rows = [("k", "/b", "public"), ("k", "/a", "private"), ("m", "/c", "public")]
    got = snapshot.deduplicated(spark.createDataFrame(rows, "repo_key string, path string, classification string"))
    assert sorted(map(tuple, got.collect())) == [("k", "/a", "private"), ("m", "/c", "public")]


def test_forge_listing(spark):
    rows = [("o/b", None, "b", "https://x/b", "git@x:b", None, False, None, False, "o", 1), ("o/a", None, "a", "https://x/a", None, None, False, None, True, "o", 2), ("o/p", None, "p", "https://x/p", None, None, True, None, False, "o", 3)]
    df = spark.createDataFrame(rows, forge.LISTING)
    assert [r.name for r in forge.listed(df, "f").collect()] == ["o/b"]
    assert [r.name for r in forge.listed(df, "f", visibility="all", include_forks=True).collect()] == ["o/a", "o/b", "o/p"]
    with pytest.raises(ValueError):
        forge.listed(df.drop("place"), "f")


@pytest.mark.parametrize("text", ["DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a = 1", "UPDATE x SET a = 1", "CACHE TABLE x", "DELETE FROM x", "EXPLAIN SELECT 1"])
def test_only_queries(spark, text):
    with pytest.raises(NotReadOnly):
        checked(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT reflect('java.lang.System', 'setProperty', 'a', 'b')", "SELECT java_method('java.lang.System', 'getProperty', 'a')", "SELECT try_reflect('java.lang.System', 'exit', 1)",
        "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'getProperty', 'a'))", "WITH a AS (SELECT java_method('java.lang.System', 'getProperty', 'a')) SELECT * FROM a",
        f"SELECT count(*) FROM parquet.`{SF}/orders.parquet`", f"SELECT (SELECT count(*) FROM parquet.`{SF}/orders.parquet`)", "SELECT * FROM nowhere", "SELECT own_function(1)",
        "SELECT x FROM range(1) LATERAL VIEW own_rows(1) AS x", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'a')", "SELECT * FROM python_worker_logs()",
        "SELECT transform(array(1), x -> java_method('java.lang.System', 'getProperty', 'a'))",
    ],
)
def test_nothing_outside_the_views(spark, text):
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(NotReadOnly):
        checked(spark, text)


def test_views_pass(spark):
    spark.range(3).createOrReplaceTempView("seen")
    checked(spark, "SELECT max(id) AS m, (SELECT count(*) FROM seen) FROM seen s JOIN (SELECT upper('a') AS u) WHERE s.id IN (SELECT id FROM Seen) GROUP BY s.id")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM secret, (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) t", "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) t UNION ALL SELECT * FROM secret",
        "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS x) SELECT * FROM a", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT (WITH secret AS (SELECT 1 AS x) SELECT max(x) FROM secret) AS m FROM secret", "SELECT 1 WHERE EXISTS (WITH secret AS (SELECT 1 AS x) SELECT 1 FROM secret) AND 1 IN (SELECT x FROM Secret)",
        "WITH a AS (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) SELECT * FROM a, secret", "SELECT from_protobuf(x, 'm', '/etc/hosts') FROM (SELECT binary('a') AS x)",
    ],
)
def test_names_of_common_table_expressions_end_with_their_scope(spark, text, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS secret USING parquet LOCATION 'file://{tmp_path}/secret' AS SELECT 7 AS x")
    try:
        with pytest.raises(NotReadOnly):
            checked(spark, text)
    finally:
        spark.sql("DROP TABLE secret")


def test_common_table_expressions_in_scope_pass(spark):
    for text in (
        "WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM A) SELECT * FROM b WHERE x IN (SELECT x FROM a)", "WITH a AS (SELECT 1 AS x) SELECT * FROM (WITH b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (x)) t",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT sum(n) FROM r", "SELECT (WITH a AS (SELECT 1 AS x) SELECT max(x) FROM a) AS m",
    ):
        assert spark.sql(checked(spark, text)).count() == 1


def test_queries_pass(spark):
    for text in ("SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT x FROM a UNION SELECT 2 ORDER BY 1 LIMIT 3", "SELECT count(*) FROM range(3) HAVING count(*) > 1", "VALUES (1), (2)"):
        checked(spark, text)


def test_numstat():
    raw = "1\t2\ta.py\0-\t-\tb.png\0" + "3\t0\t\0old\0new\0junk\0"
    assert git_history.parse_numstat(raw) == [("a.py", None, 1, 2, False), ("b.png", None, None, None, True), ("new", "old", 3, 0, False)]
