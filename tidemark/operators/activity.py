"""Activity over time: days, months, years, the week, windows before a day, streaks and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import daypart, weekday_label
from tidemark.functions.signals import change
from tidemark.operators.statistics import quantiles

def names() -> Column:
    """Sorted distinct names of the repositories behind a row."""
    return F.array_sort(F.collect_set("repository")).alias("repository_names")


def no_names() -> Column:
    """Names of a row that may have none."""
    return F.coalesce("repository_names", F.array().cast("array<string>")).alias("repository_names")


def measures() -> list[Column]:
    return [
        F.count("*").alias("commits"),
        F.countDistinct("author_key").alias("authors"),
        F.countDistinct("repo_id").alias("repositories"),
        F.sum("insertions").alias("additions"),
        F.sum("deletions").alias("deletions"),
    ]


def daily(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.col("activity_date").alias("date")).agg(*measures(), names())


def yearly(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.col("activity_year").alias("year")).agg(*measures(), names())


def monthly(commits: DataFrame) -> DataFrame:
    """Every month from the first to the last, with zeros where nothing happened."""
    month = F.trunc("activity_date", "month")
    found = commits.groupBy(month.alias("first_day")).agg(*measures(), names())
    span = found.agg(F.min("first_day").alias("lo"), F.max("first_day").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("first_day"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "authors", "repositories", "additions", "deletions")]
    return spine.join(found, "first_day", "left").select(F.date_format("first_day", "yyyy-MM").alias("month"), *filled, no_names())


def week_matrix(commits: DataFrame) -> DataFrame:
    """All 7 x 24 cells of weekday (Monday is 0) and hour."""
    return week_cells(commits.groupBy(F.col("activity_weekday").alias("weekday"), F.col("activity_hour").alias("hour")).agg(F.count("*").alias("commits"), names()))


def week_cells(found: DataFrame) -> DataFrame:
    """Counts by weekday and hour in all cells, with zeros where there are none."""
    cells = found.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    filled = cells.join(found, ["weekday", "hour"], "left")
    return filled.select("weekday", weekday_label(F.col("weekday")).alias("label"), "hour", F.coalesce("commits", F.lit(0)).alias("commits"), no_names())


def _rolled(matrix: DataFrame, *keys: Column) -> DataFrame:
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("repository_names")))).alias("repository_names")
    return matrix.groupBy(*keys).agg(F.sum("commits").alias("commits"), merged)


def weekdays(matrix: DataFrame) -> DataFrame:
    return _rolled(matrix, F.col("weekday"), F.col("label"))


def hours(matrix: DataFrame) -> DataFrame:
    return _rolled(matrix, F.col("hour"))


def dayparts(matrix: DataFrame) -> DataFrame:
    return _rolled(matrix, daypart(F.col("hour")).alias("daypart"))


def work_time(working_days: Sequence[int] = (0, 1, 2, 3, 4), start: int = 8, end: int = 18) -> list[Column]:
    """The shares of commits on other than working days, and then or outside working hours, as aggregates."""
    off = ~F.col("activity_weekday").isin(*working_days)
    late = off | (F.col("activity_hour") < start) | (F.col("activity_hour") >= end)
    all_of = F.count("*")
    return [F.try_divide(F.count_if(off), all_of).alias("weekend_share"), F.try_divide(F.count_if(late), all_of).alias("outside_work_time_share")]


def work_time_shares(commits: DataFrame, working_days: Sequence[int] = (0, 1, 2, 3, 4), start: int = 8, end: int = 18) -> DataFrame:
    return commits.agg(*work_time(working_days, start, end))


def recent_windows(commits: DataFrame, as_of: Column, days: Sequence[int] = (30, 90, 365)) -> DataFrame:
    """The last d days, ``as_of`` included, against the d days before, in one pass."""
    day = F.col("activity_date")
    counted = []
    for d in days:
        now = F.count_if(day.between(F.date_sub(as_of, d - 1), as_of))
        then = F.count_if(day.between(F.date_sub(as_of, 2 * d - 1), F.date_sub(as_of, d)))
        counted.append(F.struct(F.lit(d).alias("days"), now.alias("current"), then.alias("previous"), F.date_sub(as_of, d - 1).alias("start"), as_of.alias("end")))
    one = commits.agg(*(c.alias(f"w{d}") for c, d in zip(counted, days, strict=True)))
    rows = one.select(F.explode(F.array(*(f"w{d}" for d in days))).alias("w")).select("w.*")
    return rows.select("days", "current", "previous", change(F.col("current"), F.col("previous")).alias("delta"), "start", "end")


def calendar(commits: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Each of the last days with all measures, so that a view may switch between them."""
    spine = commits.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)).alias("date"))
    found = daily(commits.where(F.col("activity_date").between(F.date_sub(as_of, days - 1), as_of)))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "authors", "repositories", "additions", "deletions")]
    return spine.join(found, "date", "left").select("date", *filled, no_names())


def busiest_days(commits: DataFrame, limit: int = 50) -> DataFrame:
    return daily(commits).orderBy(F.desc("commits"), "date").limit(limit)


def active_day_stats(commits: DataFrame) -> DataFrame:
    per_day = commits.groupBy("activity_date").agg(F.count("*").alias("commits"))
    middle = quantiles(per_day, F.col("commits"), [0.5]).select(F.col("q0").alias("median_commits"))
    return per_day.agg(F.count("*").alias("active_days"), F.avg("commits").alias("average_commits")).crossJoin(middle)  # one row each


def _days(commits: DataFrame) -> DataFrame:
    """Distinct days: few however many commits there are, so windows over all of them stay small."""
    return commits.where("activity_date is not null").select(F.col("activity_date").alias("day")).distinct()


def longest_streak(commits: DataFrame) -> DataFrame:
    """The longest run of days in a row, the earliest of equals; zero and nulls without any day."""
    run = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    runs = _days(commits).withColumn("run", run).groupBy("run").agg(F.count("*").cast("int").alias("days"), F.min("day").alias("start"), F.max("day").alias("end"))
    best = runs.agg(F.max(F.struct("days", (-F.unix_date("start")).alias("early"), "start", "end")).alias("b"))
    return best.select(F.coalesce("b.days", F.lit(0)).alias("days"), "b.start", "b.end")


def longest_gap(commits: DataFrame) -> DataFrame:
    """The longest stretch without commits between two active days, the earliest of equals."""
    gaps = _days(commits).select("day", F.lag("day").over(Window.orderBy("day")).alias("last")).where("last is not null")
    gaps = gaps.select(F.greatest(F.lit(0), F.datediff("day", "last") - 1).alias("gap"), F.col("last").alias("start"), F.col("day").alias("end"))
    best = gaps.agg(F.max(F.struct("gap", (-F.unix_date("start")).alias("early"), "start", "end")).alias("b"))
    return best.select(F.coalesce("b.gap", F.lit(0)).alias("days_without_commits"), "b.start", "b.end")
