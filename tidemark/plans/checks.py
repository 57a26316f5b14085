"""Threshold checks of a summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = ("failed_repositories", "shallow_repositories", "dormant_repositories", "bus_factor_50")


def check(summary: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """(metric, value, limit, status) for each limit: passed, failed, or unavailable where the summary has no whole number."""
    if not limits:
        raise ValueError("no limit given")
    rows = []
    for metric, limit in limits.items():
        value = F.col(metric).cast("long") if metric in summary.columns else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.lit(int(limit)).cast("long").alias("limit")))
    each = summary.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    verdict = F.when(F.col("value").isNull(), "unavailable").when(F.col("value") <= F.col("limit"), "passed").otherwise("failed")
    return each.withColumn("status", verdict)


def passed(checks: DataFrame) -> bool:
    return checks.where("status <> 'passed'").isEmpty()
