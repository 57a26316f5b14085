"""Who contributes: contributors, concentration, identity hints, newcomers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identities import anonymised
from tidemark.operators.activity import names
from tidemark.operators.effective import usable_repositories
from tidemark.operators.statistics import concentration


def author_totals(commits: DataFrame) -> DataFrame:
    """One row for each author key."""
    return commits.groupBy("author_key").agg(
        F.max("author_name").alias("name"),
        F.max("author_email").alias("email"),
        F.max("author_is_bot").alias("is_bot"),
        F.count("*").alias("commits"),
        F.countDistinct("repo_id").alias("repositories"),
        F.countDistinct("activity_date").alias("active_days"),
        F.sum(F.col("is_merge").cast("int")).alias("merges"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.sum("files_changed").alias("files_changed"),
        F.min("activity_at").alias("first_commit"),
        F.max("activity_at").alias("last_commit"),
        names(),
    )


def contributors(commits: DataFrame, anonymise: bool = False, show_emails: bool = True) -> DataFrame:
    """Authors with their share of all commits and their churn, most active first."""
    rows = author_totals(commits)
    totals = rows.agg(F.sum("commits").alias("_all"))
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    rows = rows.withColumn("share", F.try_divide("commits", "_all")).drop("_all")
    rows = rows.withColumn("churn", F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0)))
    if anonymise:
        rows = rows.drop("name", "email").join(anonymised(rows), "author_key")
    elif not show_emails:
        rows = rows.withColumn("email", F.lit(""))
    return rows.orderBy(F.desc("commits"), F.lower("name"), "author_key")


def author_concentration(commits: DataFrame) -> DataFrame:
    return concentration(commits.groupBy("author_key").agg(F.count("*").alias("commits"))).withColumnRenamed("top_share", "top_author_share")


def _hints(commits: DataFrame, repositories: DataFrame, key: Column, shown: Column, values: Column) -> DataFrame:
    rows = commits.join(usable_repositories(repositories).select("repo_id"), "repo_id", "left_semi")
    rows = rows.select(key.alias("key"), shown.alias("shown"), values.alias("value")).where(F.trim("shown") != "")
    found = rows.groupBy("key").agg(F.max("shown").alias("shown"), F.array_sort(F.collect_set("value")).alias("values"), F.count("*").alias("commits"))
    return found.where(F.size("values") > 1)


def name_hints(commits: DataFrame, repositories: DataFrame, limit: int = 100, show_emails: bool = True) -> DataFrame:
    """Names with several addresses: perhaps one person, to be joined by an alias."""
    name, email = F.col("author_name_raw"), F.lower("author_email_raw")
    rows = _hints(commits, repositories, F.lower(name), name, email).orderBy(F.desc("commits"), "key").limit(limit)
    values = F.col("values") if show_emails else F.array().cast("array<string>")
    return rows.select(F.lit("name_multiple_emails").alias("kind"), F.col("shown").alias("name"), values.alias("values"), "commits")


def email_hints(commits: DataFrame, repositories: DataFrame, limit: int = 100, show_emails: bool = True) -> DataFrame:
    """Addresses with several names."""
    name, email = F.col("author_name_raw"), F.lower("author_email_raw")
    rows = _hints(commits, repositories, email, email, name).orderBy(F.desc("commits"), "key").limit(limit)
    shown = F.col("shown") if show_emails else F.lit("")
    return rows.select(F.lit("email_multiple_names").alias("kind"), shown.alias("email"), "values", "commits")


def top_authors(commits: DataFrame) -> DataFrame:
    """The most active author of each repository, the smaller key of equals, with the share and the repository's bus factor."""
    counts = commits.groupBy("repo_id", "author_key").agg(F.count("*").alias("commits"), F.max("author_name").alias("name"))
    best = counts.groupBy("repo_id").agg(F.sum("commits").alias("all"), F.min(F.struct((-F.col("commits")).alias("less"), "author_key", "name")).alias("b"))
    factors = concentration(counts, keys=["repo_id"]).select("repo_id", "bus_factor_50")
    rows = best.select("repo_id", F.col("b.name").alias("top_author"), F.col("b.author_key").alias("top_author_key"), (-F.col("b.less") / F.col("all")).alias("top_author_share"))
    return rows.join(factors, "repo_id")


def new_authors(commits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """How many authors first appeared in the last days."""
    first = commits.groupBy("author_key").agg(F.min("activity_date").alias("first_date"))
    return first.agg(F.count_if(F.col("first_date") >= F.date_sub(as_of, days - 1)).alias("new_authors"))


def author_summary(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """Authors over all usable repositories, whatever the settings leave out elsewhere."""
    rows = commits.join(usable_repositories(repositories).select("repo_id"), "repo_id", "left_semi")
    return rows.groupBy("author_key").agg(
        F.max("author_name").alias("author_name"),
        F.max("author_email").alias("author_email"),
        F.max("author_is_bot").alias("is_bot"),
        F.count("*").alias("commits"),
        F.countDistinct("repo_id").alias("repositories"),
        F.countDistinct("activity_date").alias("active_days"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.min("activity_at").alias("first_activity"),
        F.max("activity_at").alias("last_activity"),
    )
