"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking multiplies the cells by one factor for each source, language and topic until all
three marginals meet their targets; the factors of a cell, scaled to a token budget and trimmed at 1, are the probability with which
its documents are kept. Hashes of the rows decide, so a sample is the same each time.

Cells are few by nature and are raked on the driver up to ``max_cells``; beyond that the same steps run as aggregations, marginals and targets are tables, and only
sums come to the driver. Where ``ROUNDS`` end before the marginals of expected tokens are what is to be kept, to ``TOLERANCE``, the column ``met`` is false.

Nulls, ties and odd rows: a null source or language is a value of its own, ``(none)``, which all rows of a table without such a column have; texts without tokens (null, empty) carry no
weight and are not sampled; equal rows share one decision; values without a target keep nothing; very long texts count whole; an empty table gives no rows. All columns
of the input are passed on.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle

DIMENSIONS = ("source", "lang", "topic")
#: Targets that are not given: shares of tokens to this power, so that large ones shrink and small ones grow.
TEMPERATURE = 0.5
#: The part of all tokens to keep.
BUDGET = 0.7
ROUNDS, CLOSE = 100, 1e-9
#: How far a marginal of the expected tokens may stay from what is to be kept of it, as a part of all tokens kept.
TOLERANCE = 1e-6
MAX_CELLS = 100_000
NONE = "(none)"


def structure_topic(text: Column) -> Column:
    """A coarse topic from the make of a text: tables, symbol noise, notices, or prose by length."""
    size = F.greatest(F.lit(1), F.length(text))
    rate = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(rate(r"\|") > 0.02, "table")
        .when(rate("[#$%&*!]") > 0.04, "noise")
        .when(text.rlike("(?i)licen[sc]e|copyright"), "notice")
        .when(F.length(text) < 800, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("essay")
    )


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _targets(totals: Mapping[str, float], given: Mapping[str, float] | None) -> dict[str, float]:
    wanted = dict(given) if given is not None else {k: v**TEMPERATURE for k, v in totals.items()}
    met = {k: v for k, v in wanted.items() if totals.get(k, 0) > 0 and v > 0}
    return {k: v / sum(met.values()) for k, v in met.items()}


def rake(weights: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """A factor for each cell, so that the marginals of ``weights`` times the factors are the targets times the sum of the weights."""
    total = weights.sum()
    factor = np.where(np.all([t[p] > 0 for p, t in zip(places, targets, strict=True)], axis=0), 1.0, 0.0)
    for _ in range(ROUNDS):
        worst = 0.0
        for place, target in zip(places, targets, strict=True):
            now = np.bincount(place, weights * factor, len(target))
            step = np.divide(target * total, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, np.abs(step[now > 0] - 1).max(initial=0.0))
            factor = factor * step[place]
        if worst < CLOSE:
            break
    return factor


def attainable(totals: np.ndarray, target: np.ndarray, budget: float) -> np.ndarray:
    """Tokens to keep of each value: its target share of ``budget`` if it has that many, else all, and the others share the rest by their targets."""
    want = np.zeros(len(totals))
    free = (target > 0) & (totals > 0)
    left = min(budget, totals[free].sum())
    while free.any():
        part = np.where(free, target, 0.0)
        part = part / part.sum() * left
        over = free & (part >= totals)
        if not over.any():
            return np.where(free, part, want)
        want[over] = totals[over]
        left -= totals[over].sum()
        free &= ~over
    return want


def _steps(want: np.ndarray, spent: np.ndarray, rest: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What multiplies the cells of each value that are below 1 to meet ``want``; where none is left, what takes the lowest to 1."""
    return np.divide(np.maximum(want - spent, 0.0), rest, out=1.0 / low, where=rest > 0)


def probabilities(weights: np.ndarray, factor: np.ndarray, places: list[np.ndarray], wants: list[np.ndarray]) -> np.ndarray:
    """Raking with a ceiling: factors trimmed at 1, so that the marginals of ``weights`` times the probabilities are ``wants``."""
    odds = factor
    for _ in range(ROUNDS):
        worst = 0.0
        for place, want in zip(places, wants, strict=True):
            n = len(want)
            now = np.bincount(place, weights * np.minimum(odds, 1.0), n)
            worst = max(worst, np.abs(now - want).max() / max(want.sum(), 1.0))
            low = np.full(n, np.inf)
            live = (odds > 0) & (weights > 0)
            np.minimum.at(low, place[live], odds[live])
            step, before = np.zeros(n), -1
            while (full := odds * step[place] >= 1).sum() > before:
                before = full.sum()
                step = _steps(want, np.bincount(place, weights * full, n), np.bincount(place, weights * odds * ~full, n), low)
            odds = odds * step[place]
        if worst < TOLERANCE:
            break
    return np.minimum(odds, 1.0)


def _raked_here(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    rows = cells.orderBy(*DIMENSIONS).toPandas()
    weights = rows["tokens"].to_numpy(dtype=np.float64)
    places, shares = [], []
    for name in DIMENSIONS:
        values = sorted(set(rows[name]))
        place = {v: k for k, v in enumerate(values)}
        places.append(rows[name].map(place).to_numpy(dtype=np.int64))
        shares.append(np.array([targets[name].get(v, 0.0) for v in values]))
    factor = rake(weights, places, shares)
    reached = weights * (factor > 0)
    wants = [attainable(np.bincount(p, reached, len(t)), t, budget * weights.sum()) for p, t in zip(places, shares, strict=True)]
    chance = probabilities(weights, factor, places, wants)
    met = all(np.abs(np.bincount(p, weights * chance, len(w)) - w).max(initial=0.0) < TOLERANCE * max(w.sum(), 1.0) for p, w in zip(places, wants, strict=True))
    listed = [(*(r[n] for n in DIMENSIONS), float(f), float(p), met) for (_, r), f, p in zip(rows.iterrows(), factor, chance, strict=True)]
    return cells.sparkSession.createDataFrame(listed, ", ".join(f"{n} string" for n in DIMENSIONS) + ", weight double, probability double, met boolean")


def _goals(cells: DataFrame, name: str, asked: Mapping[str, float] | None) -> DataFrame:
    """(name, target): the share of each value that has tokens and a target."""
    have = cells.groupBy(name).agg(F.sum("tokens").alias("have")).where("have > 0")
    if asked is None:
        rows = have.select(name, F.pow("have", F.lit(TEMPERATURE)).alias("target"))
    else:
        rows = have.join(cells.sparkSession.createDataFrame([(k, float(v)) for k, v in asked.items()], f"{name} string, target double"), name).where("target > 0").select(name, "target")
    rows = settle(rows, "goals")
    return rows.withColumn("target", F.col("target") / F.lit(rows.agg(F.sum("target")).first()[0] or 1.0))


def _attainable_apart(totals: DataFrame, budget: float) -> DataFrame:
    """``attainable`` for a table (name, have, target): (name, want)."""
    left = min(budget, float(totals.agg(F.sum("have")).first()[0] or 0.0))
    now = settle(totals.withColumns({"want": F.lit(0.0), "free": F.lit(True)}), "wants")
    while True:
        shares = now.where("free").agg(F.sum("target")).first()[0]
        if not shares:
            return now.select(totals.columns[0], "want")
        part = F.col("target") / shares * left
        over = F.col("free") & (part >= F.col("have"))
        full = now.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("have"))).alias("have")).first()
        if not full["n"]:
            return now.select(totals.columns[0], F.when(F.col("free"), part).otherwise(F.col("want")).alias("want"))
        now = settle(now.withColumns({"want": F.when(over, F.col("have").cast("double")).otherwise(F.col("want")), "free": F.col("free") & ~over}), "wants")
        left -= float(full["have"])


def _raked_apart(cells: DataFrame, goals: dict[str, DataFrame], budget: float) -> DataFrame:
    """The same as aggregations over the table of cells; marginals and targets are tables beside it."""
    total = float(cells.agg(F.sum("tokens")).first()[0])
    now = cells
    for name in DIMENSIONS:
        now = now.join(goals[name].withColumnRenamed("target", f"target_{name}"), name, "left")
    now = settle(now.withColumn("weight", F.when(F.expr(" and ".join(f"target_{n} is not null" for n in DIMENSIONS)), 1.0).otherwise(0.0)), "cells")
    for _ in range(ROUNDS):
        worst = 0.0
        for name in DIMENSIONS:
            sums = now.groupBy(name).agg(F.sum(F.col("tokens") * F.col("weight")).alias("sum"), F.first(f"target_{name}").alias("target"))
            steps = settle(sums.where("sum > 0").select(name, (F.col("target") * total / F.col("sum")).alias("step")), "steps")
            worst = max(worst, steps.agg(F.max(F.abs(F.col("step") - 1))).first()[0] or 0.0)
            now = settle(now.join(steps, name, "left").withColumn("weight", F.col("weight") * F.coalesce("step", F.lit(0.0))).drop("step"), "cells")
        if worst < CLOSE:
            break
    wants = {}
    for name in DIMENSIONS:
        totals = now.where("weight > 0").groupBy(name).agg(F.sum("tokens").alias("have"), F.first(f"target_{name}").alias("target"))
        wants[name] = settle(_attainable_apart(totals, budget * total), "wants")
    whole = {name: max(float(wants[name].agg(F.sum("want")).first()[0] or 0.0), 1.0) for name in DIMENSIONS}
    far = lambda rows, name: float(rows.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0) / whole[name]
    chance = F.least("odds", F.lit(1.0))
    now = settle(now.withColumn("odds", F.col("weight")), "cells")
    for _ in range(ROUNDS):
        worst = 0.0
        for name in DIMENSIONS:
            steps, before = wants[name].select(name, F.lit(0.0).alias("step")), -1
            while True:
                state = now.join(steps, name, "left").withColumn("step", F.coalesce("step", F.lit(0.0)))
                full = F.col("odds") * F.col("step") >= 1
                sums = state.groupBy(name).agg(
                    F.count_if(full).alias("full"),
                    F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("spent"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("odds"))).alias("rest"),
                    F.min(F.when((F.col("odds") > 0) & (F.col("tokens") > 0), F.col("odds"))).alias("low"),
                    F.sum(F.col("tokens") * chance).alias("now"),
                )
                sums = settle(sums.join(wants[name], name), "sums")
                if before < 0:
                    worst = max(worst, far(sums, name))
                if (grown := sums.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]) <= before:
                    break
                before = grown
                step = F.when(F.col("rest") > 0, F.greatest(F.col("want") - F.col("spent"), F.lit(0.0)) / F.col("rest")).otherwise(F.coalesce(1 / F.col("low"), F.lit(0.0)))
                steps = sums.select(name, step.alias("step"))
            now = settle(state.withColumn("odds", F.col("odds") * F.col("step")).drop("step"), "cells")
        if worst < TOLERANCE:
            break
    met = all(far(now.groupBy(name).agg(F.sum(F.col("tokens") * chance).alias("now")).join(wants[name], name), name) < TOLERANCE for name in DIMENSIONS)
    return now.select(*DIMENSIONS, "weight", chance.alias("probability"), F.lit(met).alias("met"))


def mixed(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    seed: int = 17,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(row, source, lang, topic, n_tokens, weight, probability, met, sampled) for each row of ``docs``; ``row`` is the row itself."""
    text = F.col(text_col)
    given = lambda name: F.col(name) if name in docs.columns else F.lit(None)
    place = {"source": given(source_col), "lang": given(lang_col), "topic": topic if topic is not None else structure_topic(text)}
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in place.items()]
    draw = F.pmod(F.xxhash64(F.col(id_col), text, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    measured = docs.select(F.struct("*").alias("row"), *named, tokens(text).alias("n_tokens"), draw.alias("draw"))
    cells = settle(measured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    asked = {name: (targets or {}).get(name) for name in DIMENSIONS}
    few = cells.count() <= max_cells
    if few:  # then no dimension has more values than that
        goals = {n: _targets({r[0]: float(r[1]) for r in cells.groupBy(n).agg(F.sum("tokens")).collect()}, asked[n]) for n in DIMENSIONS}
        some = all(goals.values())
    else:
        goals = {n: _goals(cells, n, asked[n]) for n in DIMENSIONS}
        some = not any(g.isEmpty() for g in goals.values())
    if not some:
        chances = cells.select(*DIMENSIONS, F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"), F.lit(False).alias("met"))
    else:
        chances = (_raked_here if few else _raked_apart)(cells, goals, budget)
    joined = measured.join(F.broadcast(chances) if few else chances, list(DIMENSIONS))  # a broadcast of ``max_cells`` rows at most
    return joined.select("row", *DIMENSIONS, "n_tokens", "weight", "probability", "met", (F.col("draw") < F.col("probability")).alias("sampled"))
