"""Runs of a snapshot count whole or not at all, wherever they die."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from tests.test_sources import root, run, tables  # noqa: F401  a repository made on the spot
from tidemark.config import settings
from tidemark.plans import report
from tidemark.sources import git_history, snapshot
from tidemark.sources.scan import scan

KIND = "repo_id long, repo_key string, display_name string, path string, fingerprint string, classification string"


class Died(Exception):
    pass


@pytest.fixture
def shot(spark, tmp_path):
    made = snapshot.Snapshot(spark, f"file://{tmp_path}/snap")
    made.create()
    return made


def probes(spark, *numbers, print_="f", kind=None):
    return spark.createDataFrame([(k, f"k{k}", f"n{k}", f"/p{k}", print_, kind) for k in numbers], KIND)


def tags(spark, *rows):
    return spark.createDataFrame(list(rows), "repo_id long, name string")


def commits(spark, *repos):
    return spark.createDataFrame([(r, f"h{i}", 2, 5, 1, f"2024-01-0{i + 1}T00:00:00+00:00") for i, r in enumerate(repos)], "repo_id long, hash string, files_changed int, insertions long, deletions long, activity_at string")


def names(shot):
    return {r["name"] for r in shot.read("tags").collect()}


def finished(spark, shot, *repos, **rows):
    with shot.begin() as run:
        run.write("commits", commits(spark, *repos))
        run.write("tags", tags(spark, *rows.get("tags", ())))
        return run, run.finish(probes(spark, *dict.fromkeys(repos)), signature="s")


@pytest.mark.parametrize("dies", ["begun", "tags", "all tables", "registry", "silently"])
def test_a_dead_run_never_counts(spark, shot, dies, monkeypatch):
    finished(spark, shot, 1, 2, tags=[(1, "old"), (2, "kept")])
    assert names(shot) == {"old", "kept"}
    dead = shot.begin()
    with pytest.raises(Died):
        if dies in ("tags", "all tables", "registry", "silently"):
            dead.write("tags", tags(spark, (1, "dead"), (3, "dead")))
        if dies in ("all tables", "registry"):
            dead.write("commits", commits(spark, 1, 3))
        if dies == "registry":
            monkeypatch.setattr(shot, "_created", lambda *a: (_ for _ in ()).throw(Died()))
            dead.finish(probes(spark, 1, 3), signature="s")
        raise Died
    monkeypatch.undo()
    assert names(shot) == {"old", "kept"} and shot.runs().where("status = 'running'").count() == 1
    # The next run gets a number of its own, finds no tags, and nothing of the dead one comes back.
    finished(spark, shot, 1, 2, 3)
    assert names(shot) == set()
    assert [r["status"] for r in shot.runs().orderBy("run_id").collect()] == ["complete", "aborted", "complete"]
    assert [r["run_id"] for r in shot.runs().orderBy("run_id").collect()] == [1, 2, 3]
    gone = shot.clean()
    assert any(g.startswith("tags/") for g in gone) == (dies != "begun") or dies == "begun"
    assert names(shot) == set() and shot.registry().count() == 3


def test_leaving_without_an_end_aborts(spark, shot):
    with pytest.raises(Died), shot.begin() as run:
        run.write("tags", tags(spark, (1, "x")))
        raise Died
    assert shot.runs().first()["status"] == "aborted" and shot.registry().count() == 0


def test_an_overtaken_writer_is_refused(spark, shot):
    older = shot.begin(["/a"], "1.0", {"x": 1})
    older.write("tags", tags(spark, (1, "older")))
    with pytest.raises(snapshot.Busy):
        shot.begin(lease=3600)
    older.touch()
    newer = shot.begin()
    with pytest.raises(snapshot.Refused):
        older.finish(probes(spark, 1), signature="s")
    newer.write("tags", tags(spark, (1, "newer")))
    assert newer.finish(probes(spark, 1), signature="s") == "complete"
    assert names(shot) == {"newer"}
    rows = shot.runs().orderBy("run_id").collect()
    assert [(r["run_id"], r["status"]) for r in rows] == [(1, "aborted"), (2, "complete")] and rows[0]["roots"] == ["/a"] and rows[0]["tool_version"] == "1.0"
    assert report.meta(shot.runs()).first()["run"]["status"] == "complete"


def test_counters_equal_recounts(spark, shot):
    run, _ = finished(spark, shot, 1, 1, 2, tags=[(1, "a"), (2, "b")])
    made = shot.read("commits")
    want = made.agg(F.count("*").alias("commits"), F.sum("files_changed").alias("file_changes"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")).first().asDict()
    assert run.counters == want | {"releases": 2}
    assert shot.runs().first()["counters"] == run.counters
    by_repo = {r["repo_id"]: (r["commit_count"], r["insertions"], r["first_activity"]) for r in shot.registry().collect()}
    assert by_repo == {1: (2, 10, "2024-01-01T00:00:00+00:00"), 2: (1, 5, "2024-01-03T00:00:00+00:00")}
    none, _ = finished(spark, shot, 7)
    assert none.counters["releases"] == 0


def test_states_of_repositories_follow_the_runs(spark, shot):
    finished(spark, shot, 1, 2, 3, tags=[(1, "a"), (2, "b"), (3, "c")])
    assert {r["repo_key"] for r in shot.misses(probes(spark, 1, 2, 4), "s").collect()} == {"k4"} and shot.misses(probes(spark, 1), "other").count() == 1
    fails = [("k2", None, "scan", "broken"), (None, "/p3", "probe", "no access"), (None, "/p9", "probe", "gone"), ("k8", "/p8", "scan", "never read")]
    with shot.begin() as run:
        status = run.finish(cached=probes(spark, 1, kind="public"), failures=spark.createDataFrame(fails, snapshot.FAILURES), signature="s")
    assert status == "partial"
    rows = {r["repo_key"]: r for r in shot.registry().collect()}
    assert {k: (r["status"], r["active"], r["error"], r["run_id"]) for k, r in rows.items()} == {
        "k1": ("ready", True, None, 2), "k2": ("stale", True, "broken", 2), "k3": ("stale", True, "no access", 2), "k8": ("error", True, "never read", 2),
    }
    assert rows["k1"]["classification"] == "public" and rows["k2"]["classification"] == "private"
    assert names(shot) == {"a", "b", "c"} and shot.misses(probes(spark, 2), "s").count() == 1
    assert shot.errors().count() == 4 and shot.runs().where("run_id = 2").first()["repositories_failed"] == 4
    finished(spark, shot, 2)  # 1 and 3 are no longer found
    assert {r["repo_key"]: r["active"] for r in shot.registry().collect()} == {"k1": False, "k2": True, "k3": False, "k8": False}
    assert names(shot) == set()
    with shot.begin() as run:
        assert run.finish(failures=spark.createDataFrame(fails[2:3], snapshot.FAILURES)) == "failed"


def test_purge_takes_rows_and_errors(spark, shot, tmp_path, monkeypatch):
    finished(spark, shot, 1, 2, tags=[(1, "a"), (2, "b")])
    with shot.begin() as run:
        run.finish(cached=probes(spark, 1), failures=spark.createDataFrame([("k2", "/p2", "scan", "broken")], snapshot.FAILURES))
    monkeypatch.setattr(shot, "_delete_rows", lambda ids: (_ for _ in ()).throw(Died()) if ids else None)
    with pytest.raises(Died):
        shot.purge(["k2"])  # dies after it counts, before the files are gone
    monkeypatch.undo()
    assert {r["repo_key"] for r in shot.registry().collect()} == {"k1"} and names(shot) == {"a"} and shot.errors().count() == 0
    assert list((tmp_path / "snap" / "tags").rglob("repo_id=2/*.parquet"))
    shot.begin().abort()
    assert not list((tmp_path / "snap" / "tags").rglob("repo_id=2/*.parquet"))
    assert shot.registry().first()["active"]


def test_versions(spark, tmp_path):
    shot = snapshot.Snapshot(spark, f"file://{tmp_path}/none")
    with pytest.raises(snapshot.VersionError):
        shot.begin()


def test_scan_in_one_call(spark, root, tmp_path):  # noqa: F811
    top = tmp_path / "repos"
    shutil.copytree(root, top)
    broken = top / "broken"
    subprocess.run(["git", "init", "-q", str(broken)], check=True)
    (broken / ".git/HEAD").write_text("")
    s, snap = settings({"history": {"store_subjects": True}}), f"file://{tmp_path}/snap"
    first = scan(spark, snap, [top], s)
    assert (first["status"], first["commits"], first["releases"], first["tree_files"]) == ("partial", 2, 1, 5)
    shot = snapshot.Snapshot(spark, snap)
    assert shot.read("commits").count() == 2 and shot.read("file_changes").count() > 0 and shot.read("tree_comment_stats").count() > 0
    assert [(r["path"], r["stage"]) for r in shot.errors().collect()] == [(str(broken), "probe")]
    again = scan(spark, snap, [top], s)
    assert again["commits"] == 0 and shot.read("commits").count() == 2
    assert shot.runs().where("run_id = 2").first()["repositories_cached"] == 1
    run(top / "alpha", "commit", "-q", "--allow-empty", "-m", "more")
    assert scan(spark, snap, [top], s)["commits"] == 3 and shot.read("commits").count() == 3
    out = scan(spark, snap, [top], settings({"privacy": {"repository_rules": [{"match": "alpha", "classification": "exclude"}]}}))
    assert out["status"] == "failed" and shot.registry().count() == 0


def test_kinds_of_commits_and_stretches_give_the_same_rows(spark, tmp_path):
    repo = tmp_path / "long"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    for k in range(7):
        (repo / f"f{k}").write_text(f"{k}\n")
        run(repo, "add", "-A")
        run(repo, "commit", "-q", "-m", f"c{k}", when=f"2024-01-0{k + 1}T09:00:00+01:00")
    run(repo, "checkout", "-q", "-b", "side", "HEAD~3")
    (repo / "side").write_text("s\n")
    run(repo, "add", "-A")
    run(repo, "commit", "-q", "-m", "side", when="2024-01-09T09:00:00+01:00")
    run(repo, "checkout", "-q", "main")
    run(repo, "merge", "-q", "--no-ff", "-m", "merged", "side", when="2024-01-10T09:00:00+01:00")
    for over in ({}, {"max_commits_per_repository": 5}, {"first_parent": True}, {"include_merges": False}):
        s = settings({"history": over})
        whole = git_history.scan(spark, "log", [(1, str(repo))], s)
        want = sorted(map(str, whole.collect()))
        for splits in (2, 3, 20):
            parted = git_history.scan(spark, "log", [(1, str(repo))], s, splits=splits)
            assert parted.rdd.getNumPartitions() == splits and sorted(map(str, parted.collect())) == want
        for merges in (True, False):
            got = git_history.scan(spark, "log", [(1, str(repo))], s, merges=merges, splits=1 if merges else 2)
            assert sorted(map(str, got.collect())) == sorted(str(r) for r in whole.collect() if (r.parent_count > 1) == merges)
    both = git_history.scan(spark, "log", [(1, str(repo)), (2, str(repo))], settings())
    assert both.where("repo_id = 2").count() == 9 and both.count() == 18


def test_git_errors_are_told_and_deadlines_kept(tmp_path):
    with pytest.raises(RuntimeError, match="git log"):
        list(git_history._piped(str(tmp_path), ["log"], 20))
    repo = tmp_path / "r"
    repo.mkdir()
    run(repo, "init", "-q")
    with pytest.raises(RuntimeError, match="not done after"):
        list(git_history._piped(str(repo), ["-c", "alias.nap=!sleep 30", "nap"], 0.5))
    (repo / "a").write_bytes(b"x" * 70000)
    run(repo, "add", "-A")
    oid = subprocess.run(["git", "-C", str(repo), "rev-parse", ":a"], capture_output=True, text=True, check=True).stdout.strip()
    found = list(git_history._objects(str(repo), [oid, "0" * 40, oid], 20))
    assert [None if c is None else len(c) for _, c in found] == [70000, None, 70000]
