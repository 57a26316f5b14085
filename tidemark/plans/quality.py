"""What limits the figures of a whole portfolio."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portfolio_warnings(rows: DataFrame, history: Mapping[str, Any], offsets: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(code, count) of what holds: counts of repositories, errors or time zones, or 1 for a setting.

    ``rows`` are repositories with their states, ``offsets`` the time-zone offsets of commits, ``errors`` those of the latest run.
    """
    states = {"shallow_history": F.col("is_shallow"), "partial_clone": F.col("is_partial"), "stale_snapshot": F.col("status") == "stale"}
    counted = rows.agg(*(F.count_if(c).alias(code) for code, c in states.items()))
    set_so = {
        "churn_not_collected": not history["collect_churn"],
        "comments_not_collected": not history["collect_comments"],
        "file_details_not_stored": not history["store_file_details"],
        "history_cut": bool(history["max_commits_per_repository"]),
        "hashes_deduplicated": bool(history["deduplicate_global"]),
    }
    entries: list[Column] = [F.struct(F.lit(code).alias("code"), F.col(code).alias("count")) for code in states]
    entries += [F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("count")) for code, on in set_so.items() if on]
    if errors is not None:
        counted = counted.crossJoin(errors.agg(F.count("*").alias("errors")))  # one row each
        entries.append(F.struct(F.lit("errors_logged").alias("code"), F.col("errors").alias("count")))
    if offsets is not None and history["timezone"] == "commit":
        zones = offsets.agg(F.count("*").alias("zones")).select(F.when(F.col("zones") > 1, F.col("zones")).otherwise(0).alias("zones"))
        counted = counted.crossJoin(zones)
        entries.append(F.struct(F.lit("several_time_zones").alias("code"), F.col("zones").cast("long").alias("count")))
    return counted.select(F.explode(F.array(*entries)).alias("w")).select("w.*").where("count > 0")
