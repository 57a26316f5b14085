"""What commits change: types, sizes, churn, languages, comments, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.comments import KINDS, line_counts
from tidemark.functions.labels import SIZES, size_label, type_label
from tidemark.functions.signals import density
from tidemark.operators.activity import names, no_names
from tidemark.operators.effective import usable_repositories
from tidemark.operators.statistics import distribution


def commit_types(commits: DataFrame) -> DataFrame:
    rows = commits.groupBy(F.col("message_type").alias("type")).agg(
        F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.countDistinct("author_key").alias("authors"), names()
    )
    totals = rows.agg(F.sum("commits").alias("_all"))
    shared = rows.crossJoin(F.broadcast(totals))  # one row
    return shared.select("type", type_label(F.col("type")).alias("label"), "commits", "insertions", "deletions", "authors", F.try_divide("commits", "_all").alias("share"), "repository_names")


def commit_sizes(commits: DataFrame) -> DataFrame:
    """Commits other than merges by size class, every class once, in order."""
    size = size_label(F.col("stats_collected"), F.col("insertions") + F.col("deletions"))
    found = commits.where(~F.col("is_merge")).groupBy(size.alias("bucket")).agg(F.count("*").alias("commits"), names())
    spine = commits.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, SIZES))).alias("place", "bucket"))
    return spine.join(found, "bucket", "left").select("place", "bucket", F.coalesce("commits", F.lit(0)).alias("commits"), no_names())


def churn_distribution(commits: DataFrame) -> DataFrame:
    rows = commits.where(~F.col("is_merge") & F.col("stats_collected"))
    return distribution(rows, F.col("insertions") + F.col("deletions"))


def ratios() -> list[Column]:
    """Shares of commits by what is known of their messages and changes, as aggregates."""
    all_of = F.count("*")
    return [
        F.try_divide(F.count_if(F.col("message_type") != "other"), all_of).alias("typed_commit_share"),
        F.try_divide(F.count_if("has_issue_reference"), all_of).alias("issue_reference_share"),
        F.count_if("is_breaking").alias("breaking_changes"),
        F.try_divide(F.count_if("stats_collected"), all_of).alias("stats_known_share"),
    ]


def code_ratios(commits: DataFrame) -> DataFrame:
    return commits.agg(*ratios())


def _of_usable(tree: DataFrame, repositories: DataFrame) -> DataFrame:
    return tree.join(usable_repositories(repositories).select("repo_id", F.col("display_name").alias("repository")), "repo_id")


def tree_languages(tree: DataFrame, repositories: DataFrame) -> DataFrame:
    rows = _of_usable(tree, repositories).groupBy("language")
    return rows.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("repo_id").alias("repositories"), names())


def tree_totals(files: DataFrame, key: str) -> DataFrame:
    """Files and bytes by repository and ``key`` (a language or a file type), from one row for each file."""
    return files.groupBy("repo_id", key).agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def comment_stats(blobs: DataFrame) -> DataFrame:
    """(repo_id, language, kind, files, code_lines, comment_lines, blank_lines) of blobs with text and language.

    The kind ``all`` has the totals; the others have comment lines only and appear where there are any.
    """
    counted = blobs.select("repo_id", "language", line_counts(F.col("text"), F.col("language")).alias("n"))
    comments = F.col("n.line") + F.col("n.block") + F.col("n.documentation")
    whole = F.struct(F.lit("all").alias("kind"), F.lit(1).alias("files"), F.col("n.code").alias("code"), comments.alias("comments"), F.col("n.blank").alias("blank"))
    zero = F.lit(0).cast("long")
    parts = [F.struct(F.lit(k).alias("kind"), F.lit(0).alias("files"), zero.alias("code"), F.col(f"n.{k}").alias("comments"), zero.alias("blank")) for k in KINDS]
    each = counted.select("repo_id", "language", F.explode(F.array(whole, *parts)).alias("p")).where("p.kind = 'all' or p.comments > 0")
    return each.groupBy("repo_id", "language", F.col("p.kind").alias("kind")).agg(
        F.sum("p.files").alias("files"), F.sum("p.code").alias("code_lines"), F.sum("p.comments").alias("comment_lines"), F.sum("p.blank").alias("blank_lines")
    )


def comment_languages(stats: DataFrame, repositories: DataFrame) -> DataFrame:
    rows = _of_usable(stats.where("kind = 'all'"), repositories).groupBy("language")
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("files", "code_lines", "comment_lines", "blank_lines")), F.countDistinct("repo_id").alias("repositories"), names())
    return sums.withColumn("comment_density", density(F.col("comment_lines"), F.col("code_lines")))


def comment_kinds(stats: DataFrame, repositories: DataFrame) -> DataFrame:
    rows = _of_usable(stats.where("kind <> 'all'"), repositories).groupBy("kind")
    return rows.agg(F.sum("comment_lines").alias("lines"), names())


def _churn() -> list[Column]:
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("insertions", "deletions")]
    return [F.count("*").alias("touches"), *sums, F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn")]


def churn_languages(changes: DataFrame) -> DataFrame:
    """Changes by language, from file changes with their repository."""
    binary = F.sum(F.col("is_binary").cast("int")).alias("binary_changes")
    return changes.groupBy("language").agg(*_churn(), F.countDistinct("repo_id").alias("repositories"), binary, names())


def hot_files(changes: DataFrame, limit: int = 500) -> DataFrame:
    """The files that are changed most often, from file changes with repository, author and time."""
    seen = [F.countDistinct("author_key").alias("authors"), F.max("activity_at").alias("last_change")]
    rows = changes.groupBy("repo_id", "repository", "path").agg(F.min("language").alias("language"), *_churn(), *seen)
    return rows.orderBy(F.desc("touches"), F.desc("churn"), "repository", "repo_id", "path").limit(limit)


def top_directories(changes: DataFrame, limit: int = 500) -> DataFrame:
    rows = changes.groupBy("top_directory").agg(*_churn(), F.countDistinct("repo_id").alias("repositories"), names())
    return rows.orderBy(F.desc("touches"), F.desc("churn"), "top_directory").limit(limit)


def top_scopes(commits: DataFrame, limit: int = 100) -> DataFrame:
    rows = commits.where(F.trim("message_scope") != "").groupBy(F.col("message_scope").alias("scope")).agg(F.count("*").alias("commits"), names())
    return rows.orderBy(F.desc("commits"), "scope").limit(limit)


def recent_subjects(commits: DataFrame, limit: int = 500) -> DataFrame:
    rows = commits.where(F.trim("subject") != "").select("repository", "hash", "activity_at", "subject", "author_name", "message_type")
    return rows.orderBy(F.desc("activity_at"), F.desc("hash"), "repository").limit(limit)
