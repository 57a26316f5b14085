"""Who works near whom: memberships of authors in repositories, distances from reference authors, direct pairs.

An author and a repository are linked by a membership with its first and last day. Two members of a repository are near if their
spans lie within a gap of each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identities import matches_any
from tidemark.scratch import forget, kept, package_shipped

#: Members of a repository that make up one block, a power of two; and pairs of blocks that the first wave of a search for the best pairs compares.
BLOCK = 1024
WAVE = 256


class Memberships(NamedTuple):
    """Memberships that count, and one row with the number of those left out."""

    rows: DataFrame
    excluded: DataFrame


def memberships(commits: DataFrame, minimum: int = 2, trusted_only: bool = True, exclude_service: bool = True, ignored: Sequence[str] = ()) -> Memberships:
    rows = commits.where("is_trusted") if trusted_only else commits
    rows = rows.groupBy("author_key", "repo_id", "repository").agg(
        F.max("author_name").alias("author_name"),
        F.max("author_email").alias("author_email"),
        F.max("author_is_bot").alias("is_bot"),
        F.count("*").alias("commits"),
        F.min("activity_date").alias("first_date"),
        F.max("activity_date").alias("last_date"),
    )
    who = F.concat(F.coalesce("author_name", F.lit("")), F.lit(" <"), F.coalesce("author_email", F.lit("")), F.lit(">"))
    service = F.col("is_bot") | matches_any(who, ignored) if exclude_service else F.lit(False)
    out = (F.col("commits") < minimum) | service
    return Memberships(rows.where(~out), rows.agg(F.count_if(out).alias("excluded_memberships")))


def references(commits: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keys of the authors with one of these names, whatever the case."""
    authors = commits.groupBy("author_key").agg(F.max("author_name").alias("name"))
    return authors.where(F.lower("name").isin([n.casefold() for n in names])).select("author_key", "name")


def _near(gap: int, a: str, b: str) -> Column:
    return (F.col(f"{b}.first_date") <= F.date_add(f"{a}.last_date", gap)) & (F.col(f"{a}.first_date") <= F.date_add(f"{b}.last_date", gap))


def _lined_up(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``place``, a number that rises in this order: rows are dealt by ranges, and numbers of later ranges are larger."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())


def distances(members: DataFrame, start: DataFrame, gap: int = 365) -> DataFrame:
    """(author_key, distance, path): breadth-first from the authors in ``start``, with the way there.

    A repository is entered once, by the first author in line, and leads to its members near that author. The line of a level is ordered by
    the place of the author that led there, then by repository and by key. Levels and entered repositories are written once each and only looked up later: an author carries a place, the author before
    and the repository between them. Paths are put together at the end, by joins that double their length.
    """
    own = members.select("author_key", "repo_id", "repository", "first_date", "last_date")
    none = F.lit(None).cast("string")
    level = kept(_lined_up(start.select("author_key").distinct().select("author_key", none.alias("parent"), none.alias("via"), F.lit(0).alias("distance")), "author_key"), "level")
    levels, entered = [level], []
    union = lambda tables, *columns: reduce(DataFrame.union, (t.select(*columns) for t in tables))
    while not level.isEmpty():
        at = level.select("author_key", "place").join(own, "author_key")
        if entered:
            at = at.join(union(entered, "repo_id"), "repo_id", "left_anti")
        first = F.min_by(F.struct("author_key", "place", "repository", "first_date", "last_date"), F.struct("place", "repository"))
        claims = kept(at.groupBy("repo_id").agg(first.alias("c")).select("repo_id", "c.*"), "claims")
        entered.append(claims)
        met = claims.alias("c").join(own.alias("m"), F.col("c.repo_id") == F.col("m.repo_id")).where(_near(gap, "c", "m"))
        new = met.select(F.col("m.author_key").alias("author_key"), F.struct(F.col("c.place").alias("place"), F.col("c.repository").alias("via"), F.col("c.repo_id").alias("repo_id"), F.col("c.author_key").alias("parent")).alias("by"))
        new = new.join(union(levels, "author_key"), "author_key", "left_anti").groupBy("author_key").agg(F.min("by").alias("by"))
        new = new.select("author_key", "by.parent", "by.via", F.lit(len(levels)).alias("distance"), F.col("by.place").alias("before"), F.col("by.repo_id").alias("repo_id"))
        level = kept(_lined_up(new, "before", "via", "repo_id", "author_key").select("author_key", "parent", "via", "distance", "place"), "level")
        levels.append(level)
    reached = kept(union(levels, "author_key", "parent", "via", "distance"), "reached")
    for done in (*levels, *entered):
        forget(done)
    step = "array<struct<author_key:string,via_repository:string>>"
    before = F.array(F.struct(F.col("parent").alias("author_key"), F.col("via").alias("via_repository")))
    ways = reached.select("author_key", "distance", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.array()).otherwise(before).cast(step).alias("way"))
    longest = 1
    while longest < len(levels) - 1:  # each way leads ``longest`` authors back, or to the start
        above = ways.select(F.col("author_key").alias("up"), F.col("up").alias("further"), F.col("way").alias("first"))
        ways = ways.join(above, "up", "left")
        ways = kept(ways.select("author_key", "distance", F.col("further").alias("up"), F.concat(F.coalesce("first", F.array().cast(step)), "way").alias("way")), "ways")
        longest *= 2
    last = F.array(F.struct("author_key", F.lit("").alias("via_repository"))).cast(step)
    return ways.select("author_key", "distance", F.concat("way", last).alias("path"))


def author_rows(members: DataFrame, reached: DataFrame, limit: int | None = 500) -> DataFrame:
    """Authors with their distance, nearest and most active first."""
    totals = members.groupBy("author_key").agg(F.max("author_name").alias("author"), F.sum("commits").alias("commits"), F.countDistinct("repo_id").alias("repositories"))
    rows = totals.join(reached, "author_key", "left")
    via = F.array_sort(F.array_distinct(F.filter(F.transform("path", lambda s: s["via_repository"]), lambda v: v != "")))
    rows = rows.withColumn("repository_names", F.coalesce(via, F.array().cast("array<string>")))
    rows = rows.orderBy(F.asc_nulls_last("distance"), F.desc("commits"), F.lower("author"), "author_key")
    return rows.limit(limit) if limit is not None else rows


_PAIRS = "author_key string, co_author_key string, author string, co_author string, repository string, commits long, by string, co_by string"


def _best_of_blocks(gap: int, limit: int | None):
    """The near pairs of two blocks (or of one block with itself), only the ``limit`` first of them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _PAIRS.split(", ")]).empty_table()
        left = rows.column("left").to_numpy().astype(bool)
        sides = np.flatnonzero(left), (np.flatnonzero(~left) if not left.all() else np.flatnonzero(left))
        first, last, total = (rows.column(c).to_numpy().astype(np.int64) for c in ("first_day", "last_day", "total"))
        keys, names = (np.array(rows.column(c).to_pylist(), dtype=object) for c in ("author_key", "by"))
        rank = np.unique(keys, return_inverse=True)[1]
        name = np.unique(np.array(["" if n is None else f"\x01{n}" for n in names], dtype=object), return_inverse=True)[1]
        u, v = sides
        near = (first[v][None, :] <= last[u][:, None] + gap) & (first[u][:, None] <= last[v][None, :] + gap)
        if left.all():
            near &= rank[u][:, None] < rank[v][None, :]
        x, y = (side[at] for side, at in zip((u, v), np.nonzero(near), strict=True))
        turned = rank[x] > rank[y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        commits = total[x] + total[y]
        if limit is not None and len(x) > limit:
            least = np.partition(commits, len(x) - limit)[len(x) - limit]
            some = np.flatnonzero(commits >= least)
            x, y, commits = x[some], y[some], commits[some]
            some = np.lexsort((rank[y], rank[x], name[y], name[x], -commits))[:limit]
            x, y, commits = x[some], y[some], commits[some]
        take = lambda c, at: rows.column(c).combine_chunks().take(pa.array(at))
        columns = [take("author_key", x), take("author_key", y), take("name", x), take("name", y), take("repository", x), pa.array(commits, pa.int64()), take("by", x), take("by", y)]
        return pa.table(columns, [c.split()[0] for c in _PAIRS.split(", ")])

    return run


def direct_pairs(members: DataFrame, gap: int = 365, limit: int | None = 500) -> DataFrame:
    """Pairs of near members of a repository; their commits are the authors' totals over all memberships. ``limit`` keeps the most active, and without it all near pairs are the result.

    A repository's members, most active first, form blocks, so a large one is many of them. Two blocks can't hold a pair of more commits than their most active members have together, and none at all if their spans lie further
    apart than the gap. Pairs of blocks are compared in waves, those that may hold most first; once the last of the best pairs found has more commits than any pair of blocks left may have, nothing left can be among them.
    """
    spark = members.sparkSession
    package_shipped(spark)
    totals = members.groupBy("author_key").agg(F.sum("commits").alias("total"), F.max("author_name").alias("name"))
    m = members.select("repo_id", "repository", "author_key", F.unix_date("first_date").alias("first_day"), F.unix_date("last_date").alias("last_day")).join(totals, "author_key")
    m = _lined_up(m.withColumns({"by": F.lower("name"), "rest": -F.col("total")}), "repo_id", "rest", "author_key").withColumn("block", F.expr(f"place div {BLOCK}"))
    m = kept(m.drop("place", "rest"), "members")
    blocks = m.groupBy("repo_id", "block").agg(F.max("total").alias("top"), F.min("first_day").alias("since"), F.max("last_day").alias("until"))
    b, c = blocks.alias("b"), blocks.alias("c")
    meeting = (F.col("b.repo_id") == F.col("c.repo_id")) & (F.col("b.block") <= F.col("c.block")) & (F.col("c.since") <= F.col("b.until") + gap) & (F.col("b.since") <= F.col("c.until") + gap)
    waiting = kept(b.join(c, meeting).select("b.repo_id", F.col("b.block").alias("one"), F.col("c.block").alias("other"), (F.col("b.top") + F.col("c.top")).alias("bound")), "blocks")
    order = (F.desc("bound"), F.asc("repo_id"), F.asc("one"), F.asc("other"))
    best, size, rest = None, WAVE, waiting
    while True:
        wave = rest if limit is None else kept(rest.orderBy(*order).limit(size), "wave")
        sides = [wave.select("repo_id", F.col(at).alias("block"), "one", "other", F.lit(at == "one").alias("left")) for at in ("one", "other")]
        sides[1] = sides[1].where("one <> other")
        held = sides[0].union(sides[1]).join(m, ["repo_id", "block"]).drop("block")
        found = held.groupBy("repo_id", "one", "other").applyInArrow(_best_of_blocks(gap, limit), _PAIRS)
        ranked = (F.desc("commits"), F.asc("by"), F.asc("co_by"), F.asc("author_key"), F.asc("co_author_key"), F.asc("repository"))
        if limit is None:
            best = found.orderBy(*ranked)
            break
        best = kept((found if best is None else found.unionByName(best)).orderBy(*ranked).limit(limit), "best")
        last = wave.orderBy(*(F.asc("bound"), F.desc("repo_id"), F.desc("one"), F.desc("other"))).first()
        if last is None:
            break
        kinds = {f.name: f.dataType for f in waiting.schema}
        mark = [F.lit(last[c]).cast(kinds[c]) for c in ("bound", "repo_id", "one", "other")]
        after = F.struct(-F.col("bound"), "repo_id", "one", "other") > F.struct(-mark[0], *mark[1:])
        rest, size = waiting.where(after), size * 4
        held_back = best.agg(F.count("*").alias("n"), F.min("commits").alias("least")).first()
        if held_back["n"] == limit:
            rest = rest.where(F.col("bound") >= held_back["least"])
        if rest.isEmpty():
            break
    return best.orderBy(*ranked).select("author_key", "co_author_key", "author", "co_author", "repository", "commits")


def no_stats(spark: SparkSession) -> DataFrame:
    """What a report holds in place of ``stats`` where the network is switched off."""
    zero = F.lit(0).cast("long")
    one = spark.range(1).select(F.lit(False).alias("enabled"), zero.alias("authors"), zero.alias("connected_authors"), F.lit(None).cast("int").alias("max_distance"))
    return one.withColumns({"excluded_memberships": zero, "truncated": F.lit(False)})


AUTHOR_ROWS = "author_key string, author string, commits long, repositories long, distance int, path array<struct<author_key:string,via_repository:string>>, repository_names array<string>"
PAIR_ROWS = "author_key string, co_author_key string, author string, co_author string, repository string, commits long"


def model(spark: SparkSession, network: Mapping[str, Any], found: DataFrame | None = None) -> DataFrame:
    """One row about the search: whether it is on, whom it starts from and which of them it found, and the rules it goes by."""
    rules = ("enabled", "exclude_service_accounts", "min_commits_per_author_repository", "max_contribution_gap_days", "require_remote_reference")
    names = F.array(*map(F.lit, network["reference_names"])).cast("array<string>")
    one = spark.range(1).select(F.lit(bool(network["enabled"])).alias("enabled"), names.alias("reference_names"), F.struct(*(F.lit(network[r]).alias(r) for r in rules)).alias("model"))
    if found is None:
        return one.withColumn("references_found", F.array().cast("array<string>"))
    return one.crossJoin(found.agg(F.array_sort(F.collect_set("name")).alias("references_found")))  # one row each, as many names as were asked for


def stats(members: Memberships, reached: DataFrame, limit: int = 500) -> DataFrame:
    authors = members.rows.agg(F.countDistinct("author_key").alias("authors"))
    ends = reached.agg(F.count("*").alias("connected_authors"), F.max("distance").alias("max_distance"))
    one = authors.crossJoin(ends).crossJoin(members.excluded)  # one row each
    return one.withColumn("truncated", F.col("authors") > limit)
