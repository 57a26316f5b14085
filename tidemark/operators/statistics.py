"""Statistics of how counts are spread: percentiles, Gini, Herfindahl-Hirschman, bus factors.

Gini and bus factors need the counts in order. They are first grouped by value, and there are few different counts
however many authors there are, so ordering them is cheap at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import kept


def _by_value(counts: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, x, m): m rows have the value x; with what lies below and above in order."""
    grouped = counts.groupBy(*keys, F.col(value).cast("long").alias("x")).agg(F.count("*").alias("m"))
    up = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    return grouped.select(
        *keys,
        "x",
        "m",
        F.coalesce(F.sum("m").over(up), F.lit(0)).alias("below"),
        F.coalesce(F.sum("m").over(down), F.lit(0)).alias("above"),
        F.coalesce(F.sum(F.col("m") * F.col("x")).over(down), F.lit(0)).alias("summed_above"),
        F.sum(F.col("m") * F.col("x")).over(Window.partitionBy(*keys)).alias("total"),
    )


def _bus_factor(percent: int) -> Column:
    """The fewest of the largest values that hold ``percent`` of the total; whole numbers, so no rounding decides."""
    missing = F.lit(percent) * F.col("total") - 100 * F.col("summed_above")
    more = F.call_function("div", missing + 100 * F.col("x") - 1, 100 * F.col("x"))
    return F.coalesce(F.min(F.when((F.col("x") > 0) & (more <= F.col("m")), F.col("above") + F.greatest(F.lit(1).cast("long"), more))), F.lit(0).cast("long"))


def concentration(counts: DataFrame, value: str = "commits", keys: Sequence[str] = ()) -> DataFrame:
    """Top share, bus factors at 50 and 80 percent, Gini and HHI of the values, for each key or all together."""
    v = _by_value(counts.where(F.col(value) >= 0), value, keys)
    n, total = F.sum("m"), F.max("total")
    ranked = F.sum(F.col("x") * (F.col("m") * F.col("below") + F.expr("m * (m + 1) div 2")))
    positive = total > 0
    out = [
        F.when(positive, F.max("x") / total).alias("top_share"),
        _bus_factor(50).alias("bus_factor_50"),
        _bus_factor(80).alias("bus_factor_80"),
        F.when(positive, 2 * ranked / (n * total) - (n + 1) / n).alias("gini"),
        F.when(positive, F.sum(F.col("m") * F.pow(F.col("x"), 2)) / F.pow(total, 2)).alias("hhi"),
    ]
    return v.groupBy(*keys).agg(*out) if keys else v.agg(*out)


def quantiles(rows: DataFrame, value: Column, shares: Sequence[float]) -> DataFrame:
    """One row with ``q0``, ``q1`` and so on: the values at these shares of all in order, linear between neighbours; null without any value.

    Values are counted first. The different ones are dealt by ranges and each range is counted, so only the counts of ranges are added up in one place; then a range finds its own
    neighbours of each share. No task holds more than its range.
    """
    counted = rows.select(value.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("m"))
    ranged = counted.repartitionByRange("x").sortWithinPartitions("x").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))
    ranged = kept(ranged, "values")
    parts = ranged.groupBy("part").agg(F.sum("m").alias("held"))
    every = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = parts.select("part", F.coalesce(F.sum("held").over(every), F.lit(0)).alias("before"))
    total = parts.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n"))
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(before, "part").select("x", "m", (F.col("before") + F.coalesce(F.sum("m").over(inside), F.lit(0))).alias("below")).crossJoin(F.broadcast(total))  # one row
    picks = []
    for k, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("m")), F.col("x"))).cast("double").alias(f"{name}{k}"))
        picks.append(F.max(at - F.floor(at)).alias(f"part{k}"))
    one = placed.agg(*picks)
    between = [F.when(F.col(f"lo{k}") == F.col(f"hi{k}"), F.col(f"lo{k}")).otherwise((1 - F.col(f"part{k}")) * F.col(f"lo{k}") + F.col(f"part{k}") * F.col(f"hi{k}")) for k in range(len(shares))]
    return one.select(*(c.alias(f"q{k}") for k, c in enumerate(between)))


def distribution(rows: DataFrame, value: Column) -> DataFrame:
    """Mean, median, 90th and 95th percentile (linear between neighbours) and maximum."""
    one = rows.agg(F.avg(value).alias("mean"), F.max(value).alias("maximum")).crossJoin(quantiles(rows, value, [0.5, 0.9, 0.95]))  # one row each
    return one.select("mean", F.col("q0").alias("median"), F.col("q1").alias("p90"), F.col("q2").alias("p95"), "maximum")
