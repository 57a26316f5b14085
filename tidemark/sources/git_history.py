"""Commits, trees, tags and blobs of Git repositories as Spark data sources.

Each repository is one partition, or several for its log: then each of them lists the commits and reads its own stretch of the list. A task runs ``git`` read-only and turns its output into rows. What the settings
leave out is left out by ``git`` itself. Everything derived (identities, types, calendars, languages) is computed from these rows by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
import threading
from collections.abc import Iterable, Iterator, Mapping
from itertools import batched
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions import identities, paths, signals, subjects
from tidemark.scratch import package_shipped

FIELD, RECORD = "\x1f", "\x1e"
#: What ``git log`` prints of a commit: hash, parents, raw and mapped author and committer, times, subject.
FORMAT = "%x1e" + "%x1f".join(("%H", "%P", "%an", "%ae", "%aN", "%aE", "%cn", "%ce", "%cN", "%cE", "%aI", "%cI", "%s")) + "%x00"
# Limits on the blobs whose text is read.
BLOB_LIMIT = 2_000_000
_FILES = "array<struct<path:string,old_path:string,insertions:bigint,deletions:bigint,is_binary:boolean>>"
SCHEMAS = {
    "log": "repo_id long, hash string, parent_count int, author_name_raw string, author_email_raw string, author_name_mailmap string, author_email_mailmap string, "
    "committer_name_raw string, committer_email_raw string, committer_name_mailmap string, committer_email_mailmap string, authored_at string, committed_at string, "
    f"subject string, is_trusted boolean, stats_collected boolean, files {_FILES}",
    "graph": "repo_id long, hash string, parents array<string>",
    "refs": "repo_id long, name string, object_hash string",
    "tree": "repo_id long, path string, object_id string, size long",
    "tags": "repo_id long, name string, created_at string, object_hash string",
    "blobs": "repo_id long, path string, text string",
    "probe": "repo_id long, path string, root string, git_dir string, common_dir string, object_format string, head_hash string, head_branch string, default_branch string, is_bare boolean, is_shallow boolean, is_partial boolean, "
    "local_branches int, remote_branches int, tags int, remote_urls array<string>, fingerprint string",
}


def git(path: str, *args: str, timeout: float = 900, check: bool = True) -> bytes:
    """The output of a read-only git command; an error's output is part of the exception."""
    env = os.environ | {"GIT_OPTIONAL_LOCKS": "0", "GIT_NO_LAZY_FETCH": "1", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], env=env, capture_output=True, timeout=timeout)
    if done.returncode and check:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout if not done.returncode else b""


def _lines(path: str, *args: str) -> list[str]:
    return [x for x in git(path, *args, check=False).decode(errors="replace").splitlines() if x.strip()]


def revisions(path: str, history: Mapping[str, Any]) -> list[str]:
    if history["refs"]:
        return list(history["refs"])
    if history["main_branches"]:
        return _lines(path, "for-each-ref", "--format=%(refname)", "refs/heads/main", "refs/heads/master")
    head = ["HEAD"] if git(path, "rev-parse", "--verify", "-q", "HEAD", check=False) else []
    return {"current": head, "local": ["--branches", "--tags", *head], "all": ["--all"]}[history["scope"]]


def untrusted(path: str, chosen: list[str]) -> set[str]:
    """Commits among the chosen ones that no remote reference reaches."""
    remote = _lines(path, "for-each-ref", "--format=%(refname)", "refs/remotes", "refs/tidemark/trusted")
    return set(_lines(path, "rev-list", *chosen, *(["--not", *remote] if remote else [])))


def parse_numstat(raw: str) -> list[tuple[str, str | None, int | None, int | None, bool]]:
    """(path, old path, insertions, deletions, binary) of ``--numstat -z`` output. A rename has its two paths in the next two fields."""
    tokens = iter(raw.split("\0"))
    files = []
    for token in tokens:
        parts = token.lstrip("\r\n").split("\t", 2)
        if len(parts) != 3:
            continue
        added, removed, path = parts
        binary = added == "-" or removed == "-"
        if not binary and not (added.isdigit() and removed.isdigit()):
            continue
        old = None
        if not path:
            old, path = next(tokens, ""), next(tokens, "")
        if path:
            files.append((path, old, None if binary else int(added), None if binary else int(removed), binary))
    return files


def _piped(path: str, args: list[str], timeout: float, fed: Iterable[bytes] = ()) -> Iterator[bytes]:
    """What a git command writes, piece by piece, while it runs. What it is fed and what it complains of go through files, so it can't wait for this side; it is killed after ``timeout`` seconds."""
    env = os.environ | {"GIT_OPTIONAL_LOCKS": "0", "GIT_NO_LAZY_FETCH": "1", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    with tempfile.TemporaryFile() as told, tempfile.TemporaryFile() as asked:
        for part in fed:
            asked.write(part)
        asked.seek(0)
        with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, *args], env=env, stdin=asked, stdout=subprocess.PIPE, stderr=told) as run:
            late = threading.Event()
            clock = threading.Timer(timeout, lambda: (late.set(), run.kill()))
            clock.start()
            try:
                while chunk := run.stdout.read(1 << 20):
                    yield chunk
                code = run.wait()
            except GeneratorExit:
                run.kill()
                raise
            finally:
                clock.cancel()
        if late.is_set():
            raise RuntimeError(f"git {args[0]}: not done after {timeout:g} seconds")
        if code:
            told.seek(0)
            raise RuntimeError(f"git {args[0]}: {told.read().decode(errors='replace').strip()}")


def _records(pieces: Iterable[bytes]) -> Iterator[str]:
    """Output cut at its record marks while it is being written."""
    rest = b""
    for chunk in pieces:
        *whole, rest = (rest + chunk).split(RECORD.encode())
        yield from (x.decode(errors="replace") for x in whole)
    yield rest.decode(errors="replace")


def _stretch(hashes: list[str], part: int, parts: int) -> list[str]:
    return hashes[len(hashes) * part // parts : len(hashes) * (part + 1) // parts]


def _log(repo_id: int, path: str, s: Mapping[str, Any], part: int = 0, parts: int = 1, merges: bool | None = None) -> Iterator[tuple]:
    """A repository's commits, or the ``part``-th of ``parts`` stretches of them; ``merges`` tells that only those are wanted or none."""
    history, timeout = s["history"], s["performance"]["git_timeout_seconds"]
    chosen = revisions(path, history)
    if not chosen or not git(path, "rev-list", "-n1", *chosen, check=False):
        return
    churn = history["collect_churn"]
    which = ["--date-order"] + (["--first-parent"] if history["first_parent"] else [])
    which += ["--no-merges"] if not history["include_merges"] else []
    which += [f"--{k}={history[k]}" for k in ("since", "until") if history[k]]
    most = history["max_commits_per_repository"]
    which += [f"--max-count={most}"] if most else []
    # Whatever the user's own configuration says, the output is the one that is parsed.
    args = ["log", f"--format={FORMAT}", "--no-color", "--no-show-signature", "--no-ext-diff", "--no-textconv", "--ignore-submodules"]
    args += ["--numstat", "-z", "--find-renames=50%" if history["detect_renames"] else "--no-renames"] if churn else []
    args += ["--use-mailmap"] if history["respect_mailmap"] else []
    unknown = untrusted(path, chosen)
    if parts > 1:
        hashes = b"".join(_piped(path, ["rev-list", *which, *chosen, "--"], timeout)).decode().split()
        own = _stretch(hashes, part, parts)
        if not own:
            return
        alone = ["--first-parent"] if history["first_parent"] else []
        pieces = _piped(path, [*args, *alone, "--no-walk=unsorted", "--stdin"], timeout, (f"{h}\n".encode() for h in own))
    else:
        kind = [] if merges is None or most else ["--merges"] if merges else ["--no-merges"]  # a limit counts before the choice does
        pieces = _piped(path, [*args, *which, *kind, *chosen, "--"], timeout)
    for record in _records(pieces):
        if not record.strip("\0\r\n"):
            continue
        head, mark, stats = record.partition("\0")
        fields = head.split(FIELD, 12)
        if not mark or len(fields) != 13:
            raise RuntimeError(f"git log: a record of {len(fields)} fields that begins with {head[:60]!r}")
        sha, parents, *people, authored, committed, subject = fields
        if merges is not None and merges != (len(parents.split()) > 1):
            continue
        files = parse_numstat(stats) if churn else []
        yield (repo_id, sha.strip(), len(parents.split()), *people, authored, committed, subject, sha.strip() not in unknown, churn, files)


def _tree(repo_id: int, path: str, s: Mapping[str, Any]) -> Iterator[tuple]:
    for entry in git(path, "ls-tree", "-r", "-l", "-z", "HEAD", check=False).decode(errors="replace").split("\0"):
        meta, tab, name = entry.partition("\t")
        parts = meta.split()
        if tab and len(parts) == 4 and parts[1] == "blob":
            yield repo_id, name, parts[2], int(parts[3]) if parts[3].isdigit() else 0


def _graph(repo_id: int, path: str, s: Mapping[str, Any]) -> Iterator[tuple]:
    """All commits with their parents, whatever the settings leave out of the log: ways may lead through those."""
    rest = b""
    for chunk in _piped(path, ["rev-list", "--parents", "--all"], s["performance"]["git_timeout_seconds"]):
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            sha, *parents = line.decode().split()
            yield repo_id, sha, parents


def _refs(repo_id: int, path: str, s: Mapping[str, Any]) -> Iterator[tuple]:
    """References with the commits they stand for; an annotated tag stands for its commit."""
    for line in _lines(path, "for-each-ref", "--format=%(refname)%1f%(objectname)%1f%(*objectname)"):
        name, own, peeled = line.split(FIELD)
        yield repo_id, name, peeled.strip() or own


def _tags(repo_id: int, path: str, s: Mapping[str, Any]) -> Iterator[tuple]:
    form = "--format=%(refname:short)%1f%(creatordate:iso-strict)%1f%(objectname)"
    for line in _lines(path, "for-each-ref", "--sort=creatordate", form, "refs/tags"):
        parts = line.split(FIELD, 2)
        if len(parts) == 3:
            yield repo_id, parts[0], parts[1].strip() or None, parts[2]


def _objects(path: str, ids: Iterable[str], timeout: float) -> Iterator[tuple[str, bytes | None]]:
    """Each object's content in the order asked, none where it is missing; one git process answers all of them."""
    rest, need = b"", None
    for chunk in _piped(path, ["cat-file", "--batch", "--buffer"], timeout, (f"{i}\n".encode() for i in ids)):
        rest += chunk
        while True:
            if need is None:
                head, line, after = rest.partition(b"\n")
                if not line:
                    break
                fields, rest = head.split(), after
                if len(fields) != 3:
                    yield fields[0].decode(), None
                    continue
                need = fields[0].decode(), int(fields[2])
            if len(rest) < need[1] + 1:
                break
            yield need[0], rest[: need[1]]
            rest, need = rest[need[1] + 1 :], None


def _blobs(repo_id: int, path: str, s: Mapping[str, Any]) -> Iterator[tuple]:
    """Texts of HEAD's files up to the limit, asked for 500 at a time; files with a null byte are no texts."""
    wanted = ((name, oid) for _, name, oid, size in _tree(repo_id, path, s) if 0 < size <= BLOB_LIMIT)
    for some in batched(wanted, 500):
        found = _objects(path, (oid for _, oid in some), s["performance"]["git_timeout_seconds"])
        for (name, _), (_, content) in zip(some, found, strict=True):
            if content is not None and b"\0" not in content:
                yield repo_id, name, content.decode(errors="replace")


def _probe(repo_id: int, path: str, s: Mapping[str, Any]) -> Iterator[tuple]:
    one = lambda *a: (_lines(path, *a) or [None])[0]
    common = one("rev-parse", "--path-format=absolute", "--git-common-dir")
    if common is None:
        raise RuntimeError("not a repository")
    refs = _lines(path, "for-each-ref", "--format=%(refname) %(objectname)")
    kept = refs if s["history"]["scope"] == "all" else [r for r in refs if r.startswith(("refs/heads/", "refs/tags/"))]
    head = one("rev-parse", "--verify", "-q", "HEAD")
    mailmap = Path(path, ".mailmap")
    state = [*kept, f"HEAD:{head or ''}", hashlib.sha256(mailmap.read_bytes()).hexdigest() if mailmap.is_file() else ""]
    default = one("symbolic-ref", "-q", "--short", "refs/remotes/origin/HEAD")
    count = lambda prefix: sum(r.startswith(prefix) for r in refs)
    yield (
        repo_id, path, one("rev-parse", "--show-toplevel") or path, one("rev-parse", "--absolute-git-dir"), common, one("rev-parse", "--show-object-format") or "sha1", head, one("symbolic-ref", "-q", "--short", "HEAD"), default.removeprefix("origin/") if default else None,
        one("rev-parse", "--is-bare-repository") == "true", one("rev-parse", "--is-shallow-repository") == "true",
        bool(_lines(path, "config", "--get-regexp", r"remote\..*\.promisor")), count("refs/heads/"), count("refs/remotes/"), count("refs/tags/"),
        _lines(path, "config", "--get-all", "remote.origin.url"), hashlib.sha256("\n".join(state).encode()).hexdigest(),
    )


_READERS = {"log": _log, "graph": _graph, "refs": _refs, "tree": _tree, "tags": _tags, "blobs": _blobs, "probe": _probe}


class _Repository(InputPartition):
    def __init__(self, repo_id: int, path: str, part: int = 0, parts: int = 1) -> None:
        self.repo_id, self.path, self.part, self.parts = repo_id, path, part, parts


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.what = options["what"]
        self.repositories = json.loads(options["repositories"])
        self.settings = json.loads(options["settings"])
        self.tolerant = options.get("tolerant", "false").lower() == "true"
        self.splits = int(options.get("splits", "1"))
        self.merges = json.loads(options.get("merges", "null"))

    def partitions(self) -> list[InputPartition]:
        parts = self.splits if self.what == "log" else 1
        return [_Repository(int(k), p, n, parts) for k, p in self.repositories for n in range(parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no repository at all
            return
        more = (partition.part, partition.parts, self.merges) if self.what == "log" else ()
        rows = _READERS[self.what](partition.repo_id, partition.path, self.settings, *more)
        if not self.tolerant:
            yield from rows
            return
        try:
            yield from ((*row, None) for row in rows)
        except (RuntimeError, OSError, ValueError, subprocess.SubprocessError) as error:
            width = len(SCHEMAS[self.what].replace(_FILES, "files").split(","))
            yield (partition.repo_id, *[None] * (width - 1), str(error) or type(error).__name__)


class GitHistory(DataSource):
    """``spark.read.format("git_history")`` with the options ``what``, ``repositories`` (JSON pairs of id and path) and ``settings`` (JSON).

    With ``tolerant`` a repository that can't be read ends in a row of its id and an ``error``; ``splits`` are the partitions of each repository's log; ``merges`` (true or false) reads
    merges only, or none. These are options and no pushed filters, because Spark 4.1 keeps what was pushed into a Python source for all later uses of the same DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options["what"]] + (", error string" if self.options.get("tolerant", "false").lower() == "true" else "")

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, what: str, repositories: list[tuple[int, str]], settings: Mapping[str, Any], tolerant: bool = False, splits: int = 1, merges: bool | None = None) -> DataFrame:
    package_shipped(spark)
    spark.dataSource.register(GitHistory)
    options = {"what": what, "repositories": json.dumps(repositories), "settings": json.dumps(settings), "tolerant": str(tolerant).lower(), "splits": str(splits), "merges": json.dumps(merges)}
    return spark.read.format("git_history").options(**options).load()


def _person(role: str, s: Mapping[str, Any]) -> Column:
    form = "mailmap" if s["history"]["respect_mailmap"] else "raw"
    return identities.resolved(F.col(f"{role}_name_{form}"), F.col(f"{role}_email_{form}"), s["identity"]["aliases"], s["identity"]["bot_patterns"])


def with_calendar(rows: DataFrame, at: Column, timezone: str = "commit") -> DataFrame:
    """Calendar columns of an ISO time with offset: in its own zone, or in a given one."""
    shift = F.regexp_extract(at, r"([+-]\d\d):?(\d\d)$", 1), F.regexp_extract(at, r"([+-])\d\d:?(\d\d)$", 2)
    if timezone == "commit":
        local = F.to_timestamp_ntz(F.substring(at, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        sign = F.when(shift[0].startswith("-"), -1).otherwise(1)
        offset = F.when(shift[0] != "", sign * (F.abs(shift[0].cast("int")) * 60 + shift[1].cast("int"))).otherwise(0)
        text = at
    else:
        utc = F.to_timestamp(at)
        local = F.from_utc_timestamp(utc, timezone).cast("timestamp_ntz")
        offset = ((F.unix_timestamp(F.from_utc_timestamp(utc, timezone)) - F.unix_timestamp(utc)) / 60).cast("int")
        zone = F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), (F.abs(offset) / 60).cast("int"), F.abs(offset) % 60)
        text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return rows.withColumns(
        {
            "activity_at": text,
            "activity_date": F.to_date(local),
            "activity_year": F.year(local),
            "activity_month": F.month(local),
            "activity_weekday": F.weekday(local),
            "activity_hour": F.hour(local),
            "timezone_offset_minutes": offset,
        }
    )


def commits(log: DataFrame, s: Mapping[str, Any]) -> DataFrame:
    """Commits of the data model from the rows of a log."""
    history = s["history"]
    rows = log.withColumns({"a": _person("author", s), "c": _person("committer", s), "m": subjects.classified(F.col("subject"), F.col("parent_count"))})
    rows = with_calendar(rows, F.col("authored_at" if history["activity_timestamp"] == "author" else "committed_at"), history["timezone"])
    total = lambda n: F.aggregate("files", F.lit(0).cast("long"), lambda t, f: t + F.coalesce(f[n], F.lit(0)))
    who = [F.col(f"{x}.{n}").alias(f"{role}_{n}") for x, role in (("a", "author"), ("c", "committer")) for n in ("name", "email", "key", "is_bot")]
    raw = [f"{role}_{n}_{form}" for role in ("author", "committer") for n in ("name", "email") for form in ("raw", "mailmap")]
    calendar = ["activity_at", "activity_date", "activity_year", "activity_month", "activity_weekday", "activity_hour", "timezone_offset_minutes"]
    return rows.select(
        "repo_id",
        "hash",
        "parent_count",
        *raw,
        *who,
        "authored_at",
        "committed_at",
        *calendar,
        (signals.sanitized(F.col("subject")) if history["store_subjects"] else F.lit(None).cast("string")).alias("subject"),
        F.col("m.type").alias("message_type"),
        F.col("m.scope").alias("message_scope"),
        F.col("m.breaking").alias("is_breaking"),
        subjects.mentions_issue(F.col("subject")).alias("has_issue_reference"),
        (F.col("parent_count") > 1).alias("is_merge"),
        "is_trusted",
        total("insertions").alias("insertions"),
        total("deletions").alias("deletions"),
        F.size("files").alias("files_changed"),
        F.size(F.filter("files", lambda f: f["is_binary"])).alias("binary_files"),
        "stats_collected",
    )


def file_changes(log: DataFrame) -> DataFrame:
    each = log.select("repo_id", F.col("hash").alias("commit_hash"), F.explode("files").alias("f")).select("repo_id", "commit_hash", "f.*")
    return each.withColumns({"language": paths.language(F.col("path")), "top_directory": paths.top_directory(F.col("path"))})


def tree_tables(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and bytes by language, and by file type."""
    sums = [F.count("*").alias("files"), F.sum("size").alias("bytes")]
    languages = tree.groupBy("repo_id", paths.language(F.col("path")).alias("language")).agg(*sums)
    return languages, tree.groupBy("repo_id", paths.file_type(F.col("path")).alias("file_type")).agg(*sums)


def repository_signals(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """(repo_id, ci_systems, licenses): sorted distinct names."""
    ci = tree.groupBy("repo_id").agg(F.array_sort(F.collect_set(signals.ci_system(F.col("path")))).alias("ci_systems"))
    named = blobs.where(signals.is_license_file(F.col("path"))).select("repo_id", signals.license_name(F.col("text"), F.col("path")).alias("license"))
    return ci.join(named.groupBy("repo_id").agg(F.array_sort(F.collect_set("license")).alias("licenses")), "repo_id", "left").withColumn(
        "licenses", F.coalesce("licenses", F.array().cast("array<string>"))
    )
