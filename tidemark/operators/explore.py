"""Filtering a repository matrix as a viewer would, and the totals of what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.comments import KINDS
from tidemark.functions.signals import density


def filter_repositories(
    rows: DataFrame,
    names: Sequence[str] = (),
    languages: Sequence[str] = (),
    file_types: Sequence[str] = (),
    within_days: int | None = None,
    as_of: Column | None = None,
    branch: str | None = None,
) -> DataFrame:
    """Rows that meet every given condition; within a list any one will do."""
    if names:
        rows = rows.where(F.col("display_name").isin(*names))
    if languages:
        rows = rows.where(F.exists("languages", lambda x: x["language"].isin(*languages)))
    if file_types:
        rows = rows.where(F.exists("file_types", lambda x: x["file_type"].isin(*file_types)))
    if within_days is not None:
        rows = rows.where(F.datediff(as_of if as_of is not None else F.current_date(), "last_day") <= within_days)
    if branch is not None:
        rows = rows.where((F.col("head_branch") == branch) | (F.col("default_branch") == branch))
    return rows


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose rendered columns contain the text, whatever the case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in rows.columns))), F.lit(text.lower())))


def filtered_summary(rows: DataFrame) -> DataFrame:
    """The totals of the rows left; those of head trees where the rows hold them."""
    sums = [F.sum(c).alias(c) for c in ("commits", "merges", "insertions", "deletions", "files_changed", "churn", "tree_files", "tree_bytes", "code_lines", "comment_lines") if c in rows.columns]
    kinds = [F.count_if(F.col("activity_status") == s).alias(f"{s}_repositories") for s in ("active", "quiet", "dormant", "empty")]
    found = rows.agg(F.count("*").alias("repositories"), F.count_if(F.col("commits") > 0).alias("repositories_with_commits"), *kinds, *sums)
    return found.withColumn("comment_density", density(F.col("comment_lines"), F.col("code_lines"))) if {"code_lines", "comment_lines"} <= set(rows.columns) else found


def filtered_languages(rows: DataFrame) -> DataFrame:
    """The languages of the rows left, summed again, with their lines by kind of comment."""
    each = rows.select("repo_id", F.explode("languages").alias("x")).select("repo_id", "x.*")
    sums = [F.sum(c).alias(c) for c in ("files", "bytes", "code_lines", "comment_lines", "blank_lines")]
    kinds = sorted_map({k: F.sum(F.try_element_at("comment_types", F.lit(k))) for k in KINDS}).alias("comment_types")
    found = each.groupBy("language").agg(*sums, F.countDistinct("repo_id").alias("repositories"), kinds)
    return found.withColumn("comment_density", density(F.col("comment_lines"), F.col("code_lines"))).orderBy(F.desc("bytes"), "language")


def sorted_map(values: dict[str, Column]) -> Column:
    """A map of the values that aren't null."""
    return F.map_filter(F.create_map(*(x for key in sorted(values) for x in (F.lit(key), values[key]))), lambda _, v: v.isNotNull())


def filtered_file_types(rows: DataFrame) -> DataFrame:
    """The file types of the rows left, summed again."""
    each = rows.select("repo_id", F.explode("file_types").alias("x")).select("repo_id", "x.*")
    found = each.groupBy("file_type").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("repo_id").alias("repositories"))
    return found.orderBy(F.desc("bytes"), "file_type")


def merged_kinds(rows: DataFrame) -> DataFrame:
    """Comment lines by kind over all languages of the rows left."""
    each = rows.select(F.explode("languages").alias("x")).select(F.explode("x.comment_types").alias("kind", "lines"))
    return each.groupBy("kind").agg(F.sum("lines").alias("lines"))


def natural_key(text: Column, collation: str = "DE_CI_AI") -> Column:
    """A key that sorts text as a reader expects: runs of digits by their value and before other text, the rest by a collation that ignores case and accents; ``repo9`` comes before ``repo10``."""
    digits = lambda run: F.regexp_replace(run, "^0+(?=[0-9])", "")
    number = lambda run: F.concat(F.lpad(F.length(digits(run)).cast("string"), 10, "0"), digits(run))  # noqa: E731  numbers of more digits are larger
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+|[^0-9]+)"))
    is_number = lambda run: run.rlike("^[0-9]")
    return F.transform(runs, lambda run: F.struct(F.when(is_number(run), 0).otherwise(1).alias("kind"), F.when(is_number(run), number(run)).otherwise("").alias("number"), F.collate(F.when(is_number(run), "").otherwise(run), collation).alias("text")))


def sorted_view(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column as a reader expects: whole values that are numbers by value and first, then text in natural order."""
    if rows.schema[column].dataType.simpleString() != "string":
        return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))
    number, text = F.try_to_number(F.col(column), F.lit("S999999999999.999999")), natural_key(F.col(column))
    return rows.orderBy(*([F.desc_nulls_last(number), F.desc(text)] if descending else [F.asc_nulls_last(number), F.asc(text)]))
