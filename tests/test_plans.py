"""What plans read and hold, and exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark import queries
from tidemark.operators.statistics import quantiles
from tidemark.plans import report


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("values", [[], [3], [5, 1], [2] * 9, [7, 7, 1, 9], None])
def test_quantiles(spark, values):
    rng = random.Random(3)
    values = [rng.choice([rng.randint(-5, 5), rng.randint(0, 10**12)]) for _ in range(501)] if values is None else values
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    shares = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    got = quantiles(df, F.col("v"), shares).first()
    want = [float(np.percentile(values, 100 * p)) for p in shares] if values else [None] * 6
    assert [None if g is None else g for g in got] == pytest.approx(want, rel=1e-12) if values else list(got) == want


def test_no_plan_gathers_values_in_one_buffer(spark):
    for name in ("churn_percentiles", "active_day_stats"):
        text = plan(queries.QUERIES[name].run(spark, SF))
        assert "percentile" not in text and "median(" not in text


def test_summary_and_insights_read_commits_once(spark):
    """The written roll-up is the only thing they read of commits, besides the raw commits for their bots."""
    tables, commits = queries.tables(spark, SF), queries.events(spark, SF)
    rolled = report.rolled_up(commits)
    work = {"working_days": [0, 1, 2, 3, 4], "start_hour": 8, "end_hour": 18}
    one = report.summary(tables, commits, F.lit("2024-01-31").cast("date"), work, 90, 365, rolled)
    files = lambda df: plan(df).count("Relation [")
    events = lambda df: sum("Relation [event_id" in x or "event_type#" in x for x in plan(df).splitlines() if "Relation [" in x)
    assert events(queries.events(spark, SF)) >= 1 and events(one) == events(tables.commits) and files(one) > 0
    assert events(report.insights(commits, tables, rolled)) == 0
    assert rolled.count() < commits.count() + 200
