"""Bounded samples of labelled rows and of all rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold

#: Sampling works in these steps of a share.
STEPS = 1 << 20


def share(column: str | Column, part: float, seed: int) -> Column:
    """True for about this share of ids, the same ones each time."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(STEPS)) < F.lit(round(min(1.0, part) * STEPS))


def learnable(labels: DataFrame, label: str, divisor: int, held_out: int, limit: int, only: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, label) of labelled rows outside the held-out fold, about ``limit`` at most, one row for each id.

    Ids with several labels have the more frequent one, 1 if even; rows with a null id or label are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(fold("doc_id", divisor) != held_out).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    if only is not None:
        rows = rows.where(F.col("label") == only)
    return rows.where(share("doc_id", limit / max(1, rows.count()), seed))
