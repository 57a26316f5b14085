"""Reports that were written as JSON, read back and checked without a scan."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a check may look at.
REPORT = (
    "summary array<struct<failed_repositories:bigint,dormant_repositories:bigint,shallow_repositories:bigint,days_since_last_commit:bigint,bus_factor_50:bigint,commits:bigint>>, "
    "errors array<struct<run_id:bigint,path:string,stage:string,message:string>>, _corrupt string"
)
LIMITS = ("failed_repositories", "scan_errors", "dormant_repositories", "days_since_last_commit")


class NoReport(ValueError):
    """The file holds no report."""


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """One row of the stored report: ``summary``, ``errors``, and the text in ``_corrupt`` if not all of it fits."""
    text = spark.read.text(path, wholetext=True)
    made = text.select(F.from_json("value", REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    found = made.select(F.coalesce(F.size("summary"), F.lit(-1)).alias("n")).collect()
    if len(found) != 1 or found[0]["n"] < 1:
        raise NoReport(f"no report with a summary: {path}")
    return made


def check_stored(spark: SparkSession, path: str, limits: Mapping[str, int]) -> DataFrame:
    """(metric, value, limit, status) for each limit: passed, failed, or unavailable where the report has no whole number. A report without errors written has an unknown number of them."""
    if not limits:
        raise ValueError("no limit given")
    if unknown := set(limits) - set(LIMITS):
        raise ValueError(f"no such limit: {', '.join(sorted(unknown))}")
    if any(v < 0 for v in limits.values()):
        raise ValueError("limits must not be negative")
    one = read_report(spark, path)
    value = lambda m: F.when(F.size("errors") >= 0, F.size("errors").cast("long")) if m == "scan_errors" else F.col("summary")[0][m]
    rows = [F.struct(F.lit(m).alias("metric"), value(m).alias("value"), F.lit(int(limits[m])).cast("long").alias("limit")) for m in LIMITS if m in limits]
    each = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return each.withColumn("status", F.when(F.col("value").isNull(), "unavailable").when(F.col("value") <= F.col("limit"), "passed").otherwise("failed"))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m tidemark.plans.stored report.json --max-failed-repositories 0``: 0 if all limits hold, 2 if one doesn't or can't be told, 1 for no report or no limit."""
    from tidemark.session import session
    from tidemark.sinks.files import text_table

    parser = argparse.ArgumentParser()
    parser.add_argument("report")
    for m in LIMITS:
        parser.add_argument(f"--max-{m.replace('_', '-')}", type=int, dest=m)
    given = vars(parser.parse_args(arguments))
    try:
        rows = check_stored(spark or session("check"), given["report"], {m: given[m] for m in LIMITS if given[m] is not None}).collect()
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    print(text_table([r.asDict() for r in rows], ["metric", "value", "limit", "status"]))
    return 0 if all(r["status"] == "passed" for r in rows) else 2


if __name__ == "__main__":
    sys.exit(main())
