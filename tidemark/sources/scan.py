"""From folders to a snapshot in one call: discover, probe, read what has changed, write, and record what failed.

A repository that cannot be read doesn't end the scan: its task gives one row with the message in place of what is missing, and what it gave before counts no more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.globs import first_match
from tidemark.operators import code
from tidemark.scratch import forget, kept
from tidemark.sources import discovery, git_history
from tidemark.sources.snapshot import Snapshot, deduplicated, scan_signature


def _sound(spark: SparkSession, what: str, pairs: list[tuple[int, str]], settings: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """A written table of the rows of repositories that were read to their end, and (repo_id, message) of the others."""
    rows = kept(git_history.scan(spark, what, pairs, settings, tolerant=True), what)
    failed = rows.where("error is not null").select("repo_id", F.col("error").alias("message"))
    return rows.join(failed, "repo_id", "left_anti").drop("error"), failed


def scan(spark: SparkSession, root: str, folders: Sequence[str], settings: Mapping[str, Any], tool_version: str = "", force: bool = False, lease: float = 0) -> dict[str, Any]:
    """Bring the snapshot at ``root`` up to date with the repositories below ``folders``; the run's number, status and counters.

    Unchanged repositories keep their rows unless ``force`` is given; excluded ones are purged; those that are no longer found become inactive.
    """
    shot = Snapshot(spark, root)
    shot.create()
    places, issues = discovery.walk(folders, settings["discovery"])
    with shot.begin([str(f) for f in folders], tool_version, settings, lease) as run:
        numbered = [(k, *p) for k, p in enumerate(places)]
        located = spark.createDataFrame(numbered, "place int, path string, root string, display_name string")
        privacy = settings["privacy"]
        rules = [(r["match"], r["classification"].lower()) for r in privacy["repository_rules"]]
        candidates = [F.col("display_name"), F.col("path"), F.element_at(F.split("path", "/"), -1)]
        located = located.withColumn("classification", first_match(candidates, rules, privacy["default_repository_classification"].lower()))
        found = [tuple(r) for r in located.select("place", "path", "display_name", "classification").collect()]  # as many as were discovered on this machine
        run.purge(paths=[path for _, path, _, kind in found if kind == "exclude"])
        pairs = [(k, path) for k, path, _, kind in found if kind != "exclude"]
        probed, unread = _sound(spark, "probe", pairs, settings)
        names = located.select(F.col("place").cast("long").alias("repo_id"), "display_name", "classification")
        probes = probed.join(names, "repo_id").withColumn("repo_key", F.col("common_dir")).withColumnRenamed("repo_id", "place")
        probes = kept(shot.identified(deduplicated(probes)), "probes")
        signature = scan_signature(settings)
        due = probes if force else shot.misses(probes, signature)
        todo = [(r["repo_id"], r["path"]) for r in due.select("repo_id", "path").collect()]
        log, no_log = _sound(spark, "log", todo, settings)
        tree, no_tree = _sound(spark, "tree", todo, settings)
        tags, no_tags = _sound(spark, "tags", todo, settings)
        blobs, no_blobs = _sound(spark, "blobs", todo, settings)
        wrong = kept(no_log.union(no_tree).union(no_tags).union(no_blobs).groupBy("repo_id").agg(F.min("message").alias("message")), "wrong")
        good = lambda df: df.join(wrong, "repo_id", "left_anti")
        languages, types = git_history.tree_tables(good(tree))
        texts = good(blobs).withColumn("language", git_history.paths.language(F.col("path")))
        tables = {
            "commits": git_history.commits(good(log), settings), "file_changes": git_history.file_changes(good(log)), "tree_languages": languages, "tree_file_types": types,
            "tree_comment_stats": code.comment_stats(texts), "repository_signals": git_history.repository_signals(good(tree), good(blobs)), "tags": good(tags),
        }
        if not settings["history"]["store_file_details"]:
            del tables["file_changes"]
        for name, rows in tables.items():
            run.write(name, rows)
            run.touch()
        scanned = due.join(wrong, "repo_id", "left_anti")
        failures = due.join(wrong, "repo_id").select("repo_key", "path", F.lit("scan").alias("stage"), "message")
        paths = spark.createDataFrame([(k, p) for k, p in pairs], "repo_id long, path string")
        failures = failures.unionByName(unread.join(paths, "repo_id").select(F.lit(None).cast("string").alias("repo_key"), "path", F.lit("probe").alias("stage"), "message"))
        told = spark.createDataFrame([(None, p, "discovery", m) for p, m in issues], "repo_key string, path string, stage string, message string")
        status = run.finish(scanned, probes.join(due.select("repo_key"), "repo_key", "left_anti"), failures.unionByName(told), signature)
        for done in (probes, wrong):
            forget(done)
        return {"run_id": run.number, "status": status, **run.counters}
