"""Snapshots: the data model as Parquet, replaced repository by repository, in runs that count whole or not at all.

A run begins by creating a numbered record and ends by creating a second one, which says how it ended; both are created once and never changed, so a
number is given once and a run ends once. Rows go to folders that carry the run's number and a random token: a run that died leaves folders that nothing names, and its number and
folders are never used again. ``finish`` writes the registry of all repositories anew (which run's rows count for each of them) and then the record that
names it: that one step makes all tables of the run count at once. Whoever begins a run ends those that are still running as aborted, so an
older writer that is alive after all finds its end taken and is refused; with a lease it is the newcomer who is refused while the older one shows life.

The store must create a file, and rename one to a name that is free, in one step, as HDFS does.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 2
#: What is kept of a repository: what it is, how its last run went, and the run whose rows count.
REGISTRY = (
    "repo_id long, repo_key string, display_name string, path string, classification string, status string, error string, fingerprint string, scan_signature string, commit_count long, "
    "file_change_count long, insertions long, deletions long, first_activity string, last_activity string, run_id long, active boolean, data_run string"
)
PROBES = "repo_id long, repo_key string, display_name string, path string, fingerprint string, classification string"
FAILURES = "repo_key string, path string, stage string, message string"
ERRORS = "run_id long, path string, stage string, message string, created_at timestamp"
RUNS = (
    "run_id long, token string, status string, started_at timestamp, finished_at timestamp, roots array<string>, tool_version string, config string, repositories_found long, repositories_scanned long, "
    "repositories_cached long, repositories_failed long, counters map<string,long>, registry string, error_sets array<string>, purged array<long>, schemas map<string,string>"
)
#: The run that wrote a row.
RUN = "scan_run"
#: What is counted of a table while it is being written.
_COUNTED = {
    "commits": {"commits": None, "file_changes": "files_changed", "insertions": "insertions", "deletions": "deletions"},
    "tree_languages": {"tree_files": "files", "tree_bytes": "bytes"},
    "tags": {"releases": None},
}


class VersionError(ValueError):
    """The snapshot was written by another version."""


class Busy(RuntimeError):
    """Another run is alive."""


class Refused(RuntimeError):
    """This run has ended already: it was aborted when a later one began."""


def scan_signature(settings: Mapping[str, Any]) -> str:
    """What a scan depends on; report and privacy settings are not part of it."""
    parts = {k: settings[k] for k in ("history", "identity")}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


class Snapshot:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------------------------------------- the store
    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _store(self):
        return self._at().getFileSystem(self._conf)

    def _there(self, *parts: str) -> bool:
        return self._store().exists(self._at(*parts))

    def _listed(self, *parts: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._store().listStatus(self._at(*parts))) if self._there(*parts) else []

    def _loaded(self, *parts: str) -> dict[str, Any]:
        stream = self._store().open(self._at(*parts))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _created(self, name: str, what: Mapping[str, Any]) -> bool:
        """Whether this call made the record: it appears whole, and only where there was none."""
        draft = self._at("runs", f"_draft-{uuid.uuid4().hex}")
        out = self._store().create(draft, False)
        out.write(bytearray(json.dumps(what, ensure_ascii=False).encode()))
        out.close()
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
            context.rename(draft, self._at("runs", name), self._jvm.java.lang.reflect.Array.newInstance(kind, 0))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            self._store().delete(draft, False)
            return False

    # ------------------------------------------------------------------------------------------- runs
    def create(self) -> None:
        if not self._there("_meta"):
            self.spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.json(f"{self.root}/_meta")
            self._store().mkdirs(self._at("runs"))

    def check_version(self) -> None:
        found = self.spark.read.json(f"{self.root}/_meta").first()["version"] if self._there("_meta") else None
        if found != VERSION:
            raise VersionError(f"snapshot version {found}, expected {VERSION}")

    def _records(self) -> list[dict[str, Any]]:
        """Each run's begin and, where it has ended, its end, by number."""
        names = self._listed("runs")
        ended = {n for n in names if n.endswith(".end.json")}
        runs = []
        for name in names:
            if name.endswith(".begin.json"):
                number = name.split(".")[0]
                end = self._loaded("runs", f"{number}.end.json") if f"{number}.end.json" in ended else {"status": "running"}
                runs.append(self._loaded("runs", name) | end)
        return runs

    def begin(self, roots: Sequence[str] = (), tool_version: str = "", config: Mapping[str, Any] | None = None, lease: float = 0) -> Run:
        """A new run. Those still running are ended as aborted, unless one has begun or shown life within ``lease`` seconds."""
        self.check_version()
        records = self._records()
        alive = [r for r in records if r["status"] == "running"]
        for r in alive:
            touched = self._store().getFileStatus(self._at("runs", f"{r['run_id']:08d}.begin.json")).getModificationTime() / 1000
            if time.time() - touched < lease:
                raise Busy(f"run {r['run_id']} is alive")
        for r in alive:
            self._created(f"{r['run_id']:08d}.end.json", {"status": "aborted", "finished_at": _now()})
        last = self._committed()
        if last:
            self._delete_rows(last.get("purged") or [])  # where a purge died after it had begun to count
        number = max((r["run_id"] for r in records), default=0) + 1
        token = uuid.uuid4().hex[:12]
        begun = {"token": token, "started_at": _now(), "roots": list(roots), "tool_version": tool_version, "config": json.dumps(config or {}, sort_keys=True)}
        while not self._created(f"{number:08d}.begin.json", {"run_id": number} | begun):
            number += 1
        return Run(self, number, token)

    def runs(self) -> DataFrame:
        """A row for each run: running, aborted, or complete, partial or failed as its repositories went."""
        rows = [tuple(dt.datetime.fromisoformat(r[c]) if c.endswith("_at") and r.get(c) else r.get(c) for c in _names(RUNS)) for r in self._records()]
        return self.spark.createDataFrame(rows, RUNS)

    def _committed(self) -> dict[str, Any] | None:
        done = [r for r in self._records() if r.get("registry")]
        return done[-1] if done else None

    # ------------------------------------------------------------------------------------------- what counts
    def registry(self) -> DataFrame:
        """A row for each repository as of the last run that finished."""
        last = self._committed()
        return self.spark.read.schema(REGISTRY).parquet(f"{self.root}/{last['registry']}") if last else self.spark.createDataFrame([], REGISTRY)

    def errors(self) -> DataFrame:
        last = self._committed()
        sets = [f"{self.root}/{s}" for s in last["error_sets"]] if last else []
        return self.spark.read.schema(ERRORS).parquet(*sets) if sets else self.spark.createDataFrame([], ERRORS)

    def read(self, table: str) -> DataFrame:
        """The rows of the runs that the registry names, of repositories that are active."""
        self.check_version()
        counting = self.registry().where("active and data_run is not null").select("repo_id", F.col("data_run").alias(RUN))
        named = {r[0] for r in counting.select(RUN).distinct().collect()}  # at most as many as runs
        schema = ((self._committed() or {}).get("schemas") or {}).get(table)
        if schema is None:
            raise LookupError(f"no run that counts has written {table}")
        kind = StructType.fromJson(json.loads(schema)).add(RUN, "string")
        folders = [f"{self.root}/{table}/{f}" for f in self._listed(table) if f.removeprefix(f"{RUN}=") in named]
        rows = self.spark.read.schema(kind).option("basePath", f"{self.root}/{table}").parquet(*folders) if folders else self.spark.createDataFrame([], kind)
        return rows.join(counting, ["repo_id", RUN], "left_semi").drop(RUN)

    def identified(self, probes: DataFrame) -> DataFrame:
        """Probes with the number that the registry has for their repository, or a new one by its key."""
        old = self.registry().select("repo_key", F.col("repo_id").alias("_old"))
        return probes.drop("repo_id").join(old, "repo_key", "left").withColumn("repo_id", F.coalesce("_old", F.abs(F.xxhash64("repo_key")))).drop("_old")

    def misses(self, probes: DataFrame, signature: str) -> DataFrame:
        """Probes whose repository must be scanned: new, changed, scanned otherwise, or not ready."""
        ready = self.registry().where((F.col("status") == "ready") & (F.col("scan_signature") == signature)).select("repo_key", "fingerprint")
        return probes.join(ready, ["repo_key", "fingerprint"], "left_anti")

    def purge(self, repo_keys: Sequence[str] = (), paths: Sequence[str] = ()) -> None:
        """Remove repositories with all their rows and errors; the others stay as they are."""
        with self.begin() as run:
            run.purge(repo_keys, paths)
            run.finish(others_stay=True)

    def clean(self) -> list[str]:
        """Delete the folders that no repository's rows, registry or errors are in; their names. A run that is under way loses its own."""
        last = self._committed() or {}
        named = {f"{RUN}={r[0]}" for r in self.registry().where("data_run is not null").select("data_run").distinct().collect()}
        whole = {last.get("registry"), *(last.get("error_sets") or ())}
        gone = []
        for table in self._listed():
            for folder in self._listed(table) if table not in ("runs", "_meta") else ():
                if folder not in named and f"{table}/{folder}" not in whole:
                    self._store().delete(self._at(table, folder), True)
                    gone.append(f"{table}/{folder}")
        return gone

    def _delete_rows(self, repo_ids: Sequence[int]) -> None:
        for repo_id in repo_ids:
            for found in self._store().globStatus(self._at("*", f"{RUN}=*", f"repo_id={repo_id}")) or ():
                self._store().delete(found.getPath(), True)


class Run:
    """One attempt at replacing repositories' rows. Leaving the ``with`` block without ``finish`` aborts it."""

    def __init__(self, snapshot: Snapshot, number: int, token: str) -> None:
        self.snapshot, self.number, self.name = snapshot, number, f"{number:08d}-{token}"
        self.counters: dict[str, int] = {}
        self.schemas: dict[str, str] = {}
        self._gone: tuple[list[str], list[str]] = ([], [])
        self._over = False

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if not self._over:
            self.abort()

    def touch(self) -> None:
        """Show life to those who begin with a lease."""
        at = self.snapshot._at("runs", f"{self.number:08d}.begin.json")
        self.snapshot._store().setTimes(at, int(time.time() * 1000), -1)

    def abort(self) -> None:
        self._over = True
        self.snapshot._created(f"{self.number:08d}.end.json", {"status": "aborted", "finished_at": _now()})

    def write(self, table: str, rows: DataFrame) -> dict[str, int]:
        """Write the rows of the run's repositories, once for each table, and count them in the same pass. They count once the run has finished."""
        measures = {name: F.count(F.lit(1)) if column is None else F.sum(F.col(column).cast("long")) for name, column in _COUNTED.get(table, {"rows": None}).items() if column is None or column in rows.columns}
        seen = Observation()
        rows = rows.withColumn("repo_id", F.col("repo_id").cast("long"))
        watched = rows.observe(seen, *(m.alias(k) for k, m in measures.items()))
        watched.write.partitionBy("repo_id").parquet(f"{self.snapshot.root}/{table}/{RUN}={self.name}")
        self.schemas[table] = rows.schema.json()
        found = {k: int(v or 0) for k, v in seen.get.items()}
        self.counters |= found if table in _COUNTED else {f"{table}_{k}": v for k, v in found.items()}
        return found

    def written(self, table: str) -> DataFrame | None:
        """What this run has written of a table."""
        if table not in self.schemas:
            return None
        return self.snapshot.spark.read.schema(StructType.fromJson(json.loads(self.schemas[table]))).parquet(f"{self.snapshot.root}/{table}/{RUN}={self.name}")

    def purge(self, repo_keys: Sequence[str] = (), paths: Sequence[str] = ()) -> None:
        """Remove these repositories, and the errors at their paths, when the run finishes."""
        self._gone[0].extend(repo_keys)
        self._gone[1].extend(paths)

    def _counts(self) -> DataFrame:
        """By repository, from the narrow columns of the commits that the run wrote."""
        rows = self.written("commits")
        names = ("commit_count", "file_change_count", "insertions", "deletions", "first_activity", "last_activity")
        if rows is None:
            return self.snapshot.spark.createDataFrame([], "repo_id long, " + ", ".join(c for c in REGISTRY.split(", ") if c.split()[0] in names))
        have = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        return rows.groupBy(F.col("repo_id").cast("long").alias("repo_id")).agg(
            F.count("*").alias("commit_count"),
            *(F.coalesce(F.sum(have(c, "long")), F.lit(0)).alias(n) for n, c in (("file_change_count", "files_changed"), ("insertions", "insertions"), ("deletions", "deletions"))),
            F.min(have("activity_at", "string")).alias("first_activity"),
            F.max(have("activity_at", "string")).alias("last_activity"),
        )

    def _none(self, schema: str) -> DataFrame:
        return self.snapshot.spark.createDataFrame([], schema)

    def finish(self, scanned: DataFrame | None = None, cached: DataFrame | None = None, failures: DataFrame | None = None, signature: str = "", others_stay: bool = False) -> str:
        """Make the run count; its status.

        ``scanned`` and ``cached`` are probes: of repositories whose rows this run wrote, and of those found unchanged. ``failures`` are told by key or, where a probe failed, by path: a repository
        with older commits becomes stale and keeps them, a known key without any is in error, an unknown path is an error only. What none of the three names is no longer active,
        unless the others stay. Raises ``Refused`` if the run was ended by another, and then nothing of it counts.
        """
        shot, name = self.snapshot, self.name
        scanned, cached = (self._none(PROBES) if p is None else _with_columns(p, PROBES) for p in (scanned, cached))
        failures = self._none(FAILURES) if failures is None else _with_columns(failures, FAILURES)
        keys, paths = self._gone
        old = shot.registry()
        purged = [r[0] for r in old.where(F.col("repo_key").isin(keys) | F.col("path").isin(paths)).select("repo_id").collect()] if keys or paths else []  # at most as many as were named
        old = old.where(~F.col("repo_id").isin(purged)) if purged else old
        by_path = old.select(F.col("repo_key").alias("_key"), F.col("path").alias("_path"))
        failed = failures.join(by_path, failures["path"] == F.col("_path"), "left").withColumn("repo_key", F.coalesce("repo_key", "_key")).where("repo_key is not null")
        failed = failed.groupBy("repo_key").agg(F.min("message").alias("error"), F.min("path").alias("failed_at"))
        new = scanned.join(failed.select("repo_key"), "repo_key", "left_anti").select("*", F.lit("scanned").alias("how"))
        new = new.unionByName(cached.join(failed.select("repo_key"), "repo_key", "left_anti").select("*", F.lit("cached").alias("how")))
        named = failed.join(scanned.unionByName(cached).dropDuplicates(["repo_key"]), "repo_key", "left").select("repo_key", "error", "failed_at", *(F.col(c) for c in _names(PROBES) if c != "repo_key"), F.lit("failed").alias("how"))
        new = new.unionByName(named, allowMissingColumns=True).dropDuplicates(["repo_key"]).select("repo_key", F.struct(*(c for c in (*_names(PROBES), "error", "failed_at", "how") if c != "repo_key")).alias("n"))
        counts = self._counts().select("repo_id", F.struct(*(c for c in self._counts().columns if c != "repo_id")).alias("c"))
        rows = old.select("repo_key", F.struct(*_names(REGISTRY)).alias("o")).join(new, "repo_key", "full").join(counts, F.col("n.repo_id") == counts["repo_id"], "left")
        fresh, seen = F.col("n.how") == "scanned", F.col("n").isNotNull()
        had = F.coalesce("o.commit_count", F.lit(0).cast("long"))
        status = F.when(~seen, F.col("o.status")).when(fresh, "ready").when(F.col("n.how") == "cached", F.col("o.status")).otherwise(F.when(had > 0, "stale").otherwise("error"))
        number = lambda c: F.when(fresh, F.coalesce(f"c.{c}", F.lit(0).cast("long"))).otherwise(F.coalesce(f"o.{c}", F.lit(0).cast("long")))
        pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}")
        of_scan = lambda c, value: F.when(fresh, value).otherwise(F.col(f"o.{c}"))
        columns: dict[str, Column] = {
            "repo_id": F.coalesce("o.repo_id", "n.repo_id", F.abs(F.xxhash64("repo_key"))),
            "repo_key": F.col("repo_key"),
            "display_name": pick("display_name"),
            "path": F.coalesce("n.path", "o.path", "n.failed_at"),
            "classification": F.coalesce("n.classification", "o.classification", F.lit("private")),
            "status": status,
            "error": F.when(seen, F.col("n.error")).otherwise(F.col("o.error")),
            "fingerprint": of_scan("fingerprint", F.col("n.fingerprint")),
            "scan_signature": of_scan("scan_signature", F.lit(signature)),
            **{c: number(c) for c in ("commit_count", "file_change_count", "insertions", "deletions")},
            **{c: of_scan(c, F.col(f"c.{c}")) for c in ("first_activity", "last_activity")},
            "run_id": F.when(seen, F.lit(self.number).cast("long")).otherwise(F.col("o.run_id")),
            "active": F.coalesce("o.active", F.lit(False)) | seen if others_stay else seen,
            "data_run": of_scan("data_run", F.lit(name)),
        }
        rows.select(*(c.alias(k) for k, c in columns.items())).write.parquet(f"{shot.root}/registry/{name}")
        last = shot._committed()
        sets = list(last["error_sets"]) if last else []
        told = failures.select(F.lit(self.number).cast("long").alias("run_id"), "path", "stage", "message", F.current_timestamp().alias("created_at"))
        if purged or paths:
            where = [*paths, *(r[0] for r in shot.registry().where(F.col("repo_id").isin(purged)).select("path").collect())]
            told, sets = told.unionByName(shot.errors()).where(~F.coalesce(F.col("path").isin(where), F.lit(False))), []
        told.write.parquet(f"{shot.root}/errors/{name}")
        n = {f"repositories_{k}": df.select("repo_key").distinct().count() for k, df in (("scanned", scanned.join(failed, "repo_key", "left_anti")), ("cached", cached.join(failed, "repo_key", "left_anti")))}
        n["repositories_failed"] = failures.select(F.coalesce("repo_key", "path")).distinct().count()
        n["repositories_found"] = sum(n.values())
        status = "complete" if not n["repositories_failed"] else "partial" if n["repositories_scanned"] + n["repositories_cached"] else "failed"
        end = {"status": status, "finished_at": _now(), "counters": self.counters, "registry": f"registry/{name}", "error_sets": [*sets, f"errors/{name}"], "purged": purged, "schemas": (last.get("schemas") or {} if last else {}) | self.schemas}
        self._over = True
        if not shot._created(f"{self.number:08d}.end.json", end | n):
            raise Refused(f"run {self.number} was ended when a later one began")
        shot._delete_rows(purged)
        return status


def _with_columns(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, null where ``rows`` has none."""
    return rows.select(*((F.col(c.split()[0]) if c.split()[0] in rows.columns else F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))


def deduplicated(locations: DataFrame) -> DataFrame:
    """One location for each repository key, the first by path, with the strictest classification of all its work trees."""
    order = F.when(F.col("classification") == "exclude", 0).when(F.col("classification") == "private", 1).otherwise(2)
    rows = locations.withColumn("_rank", order).groupBy("repo_key").agg(F.min("_rank").alias("_rank"), F.min_by(F.struct(*locations.columns), "path").alias("l"))
    names = F.element_at(F.array(F.lit("exclude"), F.lit("private"), F.lit("public")), F.col("_rank") + 1)
    return rows.select(*(names.alias(c) if c == "classification" else F.col(f"l.{c}").alias(c) for c in locations.columns))
