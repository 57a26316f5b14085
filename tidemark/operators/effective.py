"""The rows that every metric reads: usable repositories, effective commits and their file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USABLE = ("ready", "stale")


def usable_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.where(F.col("active") & F.col("status").isin(*USABLE))


def effective_commits(commits: DataFrame, repositories: DataFrame, include_bots: bool = True, deduplicate: bool = False) -> DataFrame:
    """Commits of usable repositories with the repository's name.

    Bots go before equal hashes are reduced to the repository with the smallest id.
    """
    names = usable_repositories(repositories).select("repo_id", F.col("display_name").alias("repository"))
    rows = commits.join(names, "repo_id")
    if not include_bots:
        rows = rows.where(~F.col("author_is_bot"))
    if deduplicate:
        rank = F.row_number().over(Window.partitionBy("hash").orderBy("repo_id"))
        rows = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return rows


def effective_file_changes(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """File changes of the given commits."""
    return changes.join(commits.select("repo_id", F.col("hash").alias("commit_hash")), ["repo_id", "commit_hash"], "left_semi")


def with_author(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """File changes with the repository, author and time of their commit."""
    own = commits.select("repo_id", F.col("hash").alias("commit_hash"), "repository", "author_key", "activity_at")
    return changes.join(own, ["repo_id", "commit_hash"])
