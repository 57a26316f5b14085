"""The core aggregations over a stream of commits: windows with watermarks, deduplication, bursts, incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def unique_commits(commits: DataFrame, lateness: str = "7 days", ts: str = "activity_ts") -> DataFrame:
    """Each hash once within the lateness: global deduplication without unbounded state."""
    return commits.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["hash"])


def daily(commits: DataFrame, lateness: str | None = "7 days", ts: str = "activity_ts") -> DataFrame:
    """Commits and lines by day; distinct authors approximately, since exact ones would keep every key in state.

    A stream that has a watermark, as unique commits do, takes None for the lateness.
    """
    windows = (commits.withWatermark(ts, lateness) if lateness else commits).groupBy(F.window(ts, "1 day"))
    rows = windows.agg(
        F.count("*").alias("commits"), F.approx_count_distinct("author_key", 0.01).alias("authors"), F.sum("insertions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    return rows.select(F.to_date("window.start").alias("date"), "commits", "authors", "additions", "deletions")


def bursts(commits: DataFrame, gap: str = "2 hours", lateness: str = "7 days", ts: str = "activity_ts") -> DataFrame:
    """Runs of an author's commits without a longer break."""
    sessions = commits.withWatermark(ts, lateness).groupBy("author_key", F.session_window(ts, gap))
    return sessions.agg(F.count("*").alias("commits")).select("author_key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "commits")


def replace_partitions(commits: DataFrame, path: str, checkpoint: str, partition: str = "repo_id") -> DataStreamWriter:
    """A writer that keeps the rows of every batch by partition and batch: a batch that is run again replaces its own rows and no others.

    A rescan replaces a repository for readers by its run, however many batches it is spread over: see ``latest_runs``.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "batch").parquet(path)

    return commits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_runs(rows: DataFrame, partition: str = "repo_id", run: str = "run_id") -> DataFrame:
    """The rows of each partition's greatest run, whichever batches brought them."""
    last = rows.groupBy(partition).agg(F.max(run).alias(run))
    return rows.join(last, [partition, run], "left_semi")
