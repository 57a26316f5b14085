"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels of the learnable folds, at most about ``limit`` of them (a bounded sample of labelled rows, a parameter), weigh a lexicon of words and word
starts and train the trees; a third of them, kept from the lexicon and the trees, calibrates. Examples that train the trees take their features from
lexicons without their own fold (``FOLDS`` of them), so no tree sees a word that its own label listed. Every text is then scored whole, in one pass
without a shuffle.

``LEXICON`` entries, ``MOST`` counts of a unit in one text, ``SUPPORT`` and ``DEVIATIONS`` are parameters of the model, as the number of trees is: they
choose what it learns from examples and drop no row. A larger lexicon lists rarer units of less evidence.

Nulls, ties and odd rows: a null text is empty and scored like one; rows with a null id are held out of learning and are scored; labels without
a text and texts without a label are no examples; very long texts count whole. Without ``LEAST_EXAMPLES`` of both classes nothing is learned:
every score is 0 and ``learned`` is false. Repeated rows get equal scores. All columns of the input are passed on in ``row``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fold, settle, small_batches
from tidemark.llm.labelled import learnable, share
from tidemark.llm.text_features import WORD, toxic_features, units

DIVISOR, HELD_OUT = 3, 1
#: Labelled rows to learn from, about; entries of the lexicon.
LIMIT, LEXICON = 20_000, 2_000
THRESHOLD = 0.7
#: Parts of the training examples for lexicons that leave one part out.
FOLDS = 5
#: A text counts a unit this often at most; a unit is listed from this many toxic texts and deviations on.
MOST, SUPPORT, DEVIATIONS = 5, 5, 5.0
LEAST_EXAMPLES = 5


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, label, text) to counts of each unit in one part: in clean texts, in toxic ones, and the toxic texts that hold it."""
    for batch in batches:
        tallies: tuple[Counter, ...] = Counter(), Counter(), Counter()
        for part, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = Counter()
            for word, c in Counter(WORD.findall((text or "").lower())).items():
                for unit in units([word]):
                    counts[unit] += c
            for unit, c in counts.items():
                tallies[label][part, unit] += min(c, MOST)
                tallies[2][part, unit] += label
        names = list(tallies[0] | tallies[1])
        columns = [pa.array([t[u] for u in names], pa.int64()) for t in tallies]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in names], pa.int32()), pa.array([u for _, u in names], pa.string()), *columns], names=["part", "unit", "clean", "toxic", "support"])


def lexicons(examples: DataFrame, entries: int = LEXICON) -> list[dict[str, float]]:
    """Units that are more frequent in toxic examples than chance would have it, with the logarithm of the ratio.

    ``examples`` has columns part (0 to FOLDS - 1), label and text. Lexicon k leaves part k out and the last one leaves out nothing; at most ``entries`` units each.
    """
    sizes = {(r["part"], r["label"]): r["count"] for r in examples.groupBy("part", "label").count().collect()}
    total = [sum(n for (_, y), n in sizes.items() if y == label) for label in (0, 1)]
    rest = [(k, *(float(total[y] - sizes.get((k, y), 0)) for y in (0, 1))) for k in range(FOLDS + 1)]
    counted = examples.select("part", "label", "text").mapInArrow(_count_units, "part int, unit string, clean long, toxic long, support long")
    parts = counted.groupBy("unit", "part").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "support")))
    whole = parts.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "support")), F.map_from_entries(F.collect_list(F.struct("part", F.struct("clean", "toxic", "support")))).alias("own"))
    without = [F.struct(F.lit(k).alias("part"), F.lit(c).alias("cleans"), F.lit(t).alias("toxics")) for k, c, t in rest if c and t]
    made: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    if not without:
        return made
    left = whole.where(F.col("support") >= SUPPORT).select("*", F.explode(F.array(*without)).alias("rest")).select("*", "rest.*")
    own = lambda c: F.coalesce(F.try_element_at("own", "part")[c], F.lit(0))
    left = left.select("part", "unit", "cleans", "toxics", *((F.col(c) - own(c)).alias(c) for c in ("clean", "toxic", "support"))).where(F.col("support") >= SUPPORT)
    clean, toxic = F.col("clean") / F.col("cleans"), F.col("toxic") / F.col("toxics")
    spread = F.sqrt((F.col("clean") + F.col("toxic") + 1) / (F.col("cleans") + F.col("toxics")) * (1 / F.col("cleans") + 1 / F.col("toxics")))
    weight = F.log((F.col("toxic") + 0.5) / F.col("toxics")) - F.log((F.col("clean") + 0.5) / F.col("cleans"))
    found = left.select("part", "unit", ((toxic - clean) / spread).alias("sure"), weight.alias("weight")).where((F.col("sure") > DEVIATIONS) & (F.col("weight") > 0.7))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("sure"), "unit"))).where(F.col("place") <= entries)
    for r in best.collect():
        made[r["part"]][r["unit"]] = r["weight"]
    return made


def _featured(rows: DataFrame, words: list[dict[str, float]]) -> DataFrame:
    """Add the features of ``text`` by the lexicon that ``part`` names to (row, part, text) and drop both."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = pa.array([toxic_features(t or "", words[k]) for k, t in pairs], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "features"])

    return rows.mapInArrow(add, f"row {rows.schema['row'].dataType.simpleString()}, features array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """(row, held_out, score, predicted, learned) for each row of ``docs``; ``row`` is the row itself."""
    small_batches(docs.sparkSession)
    wanted = learnable(labels, "toxic", DIVISOR, HELD_OUT, limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The calibrating third has no part. ``wanted`` has about ``limit`` rows, so its broadcast is bounded.
    part = F.when(~share("doc_id", 1 / 3, 2), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int"))
    examples = settle(texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", part.alias("part"), "text"), "examples")
    sizes = {(r["apart"], r["label"]): r["count"] for r in examples.groupBy(F.isnull("part").alias("apart"), "label").count().collect()}
    learned = min(sizes.get((False, label), 0) for label in (0, 1)) >= LEAST_EXAMPLES
    rows = docs.select(F.struct("*").alias("row"), F.lit(FOLDS).alias("part"), F.col(text_col).alias("text"))
    if learned:
        words = lexicons(examples.where("part is not null"))
        known = _featured(examples.select(F.struct("doc_id", "label", F.isnull("part").alias("apart")).alias("row"), F.coalesce("part", F.lit(FOLDS)).alias("part"), "text"), words)
        known = settle(known.select("row.apart", F.col("row.label").cast("double").alias("label"), "features"), "known")
        known = known.coalesce(4).select("apart", "label", array_to_vector("features").alias("features"))
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, maxBins=64, minInstancesPerNode=3, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=7, cacheNodeIds=False).fit(known.where("not apart"))
        scored = trees.transform(_featured(rows, words).select("row", array_to_vector("features").alias("features")))
        scored = scored.select("row", vector_to_array("probability")[1].alias("raw"))
        score = F.col("raw")
        if all(sizes.get((True, label), 0) for label in (0, 1)):
            raised = trees.transform(known.where("apart")).select("label", vector_to_array("probability")[1].alias("raw"))
            scored = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raised).transform(scored)
            # Isotonic regression has flat steps; a thousandth of the raw score keeps the order within them.
            score = F.col("calibrated") * 0.999 + F.col("raw") * 0.001
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    else:
        scored, score = rows.select("row"), F.lit(0.0)
    held_out = F.coalesce(fold(f"row.{id_col}", DIVISOR) == HELD_OUT, F.lit(False))
    scored = scored.select("row", held_out.alias("held_out"), score.alias("score"))
    return scored.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "learned": F.lit(learned)})
