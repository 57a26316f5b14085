"""Quality by positive-unlabelled learning.

Trusted positives are labelled good texts of the learnable folds; the unlabelled side is all texts. The class prior is the least ratio of unlabelled to
positive texts above a score, over all scores, for a classifier that tells the two sides apart, on positives it was not fit on; it is
taken from the scores of every text, counted by score in one aggregation. A small network then minimises the non-negative unbiased risk with that prior; its
output is the probability that a text is good. Negative labels are never read.

Bounds: networks are fit on the driver, in numpy, from the features (22 numbers each) of about ``limit`` labelled positives and of about ``unlabelled`` texts,
a sample by hash for the gradient steps only: the unlabelled risk is a mean, so a sample of m rows moves it by about 1 / sqrt(m). The prior, the
scores and the decisions cover all rows. Every text is read whole, twice (prior, score), without a shuffle.

Nulls, ties and odd rows: a null text is empty and scored like one; rows with a null id are scored; labels without a text are no examples; very long texts
count whole. With fewer than ``LEAST_EXAMPLES`` trusted positives nothing is learned: every score is 0.5 and ``learned`` is false, so that who filters can keep
all rows. Repeated rows get equal scores. All columns of the input are passed on in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, small_batches
from tidemark.llm.labelled import learnable, share
from tidemark.llm.text_features import quality_features

DIVISOR, HELD_OUT = 4, 2
#: Labelled positives, and unlabelled texts for the gradient steps, about.
LIMIT, UNLABELLED = 15_000, 15_000
#: Scores at which positives and all texts are counted.
CUTS = 181
THRESHOLD = 0.7
HIDDEN, STEPS, BATCH = 16, 1500, 512
LEAST_EXAMPLES = 10


class Net:
    """One hidden layer over standardised features, by Adam."""

    def __init__(self, width: int, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.weights = [self.rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), self.rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.means = [np.zeros_like(w) for w in self.weights]
        self.squares = [np.zeros_like(w) for w in self.weights]
        self.steps = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.weights[0] + self.weights[1])
        return hidden, hidden @ self.weights[2] + self.weights[3][0]

    def descend(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray, rate: float = 0.01, decay: float = 1e-4) -> None:
        """One step against ``slope``, the derivative of the loss by each row's output."""
        back = np.outer(slope, self.weights[2]) * (1 - hidden**2)
        self.steps += 1
        for k, g in enumerate((x.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()]))):
            g = g + decay * self.weights[k]
            self.means[k] = 0.9 * self.means[k] + 0.1 * g
            self.squares[k] = 0.999 * self.squares[k] + 0.001 * g**2
            self.weights[k] -= rate * (self.means[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.squares[k] / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int, steps: int = STEPS) -> Net:
    """Minimise the non-negative unbiased risk under ``prior``; without one, tell the two samples apart.

    With logistic loss l, the risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]); where the second part turns negative its gradient is
    followed upwards.
    """
    net = Net(positive.shape[1], seed)
    for step in range(steps):
        p = positive[net.rng.integers(0, len(positive), BATCH)]
        u = unlabelled[net.rng.integers(0, len(unlabelled), BATCH)]
        x = np.concatenate([p, u])
        hidden, out = net.forward(x)
        chance = sigmoid(out)
        on_p, on_u = chance[:BATCH], chance[BATCH:]
        if prior is None:
            slope = np.concatenate([on_p - 1, on_u]) / BATCH
        else:
            negative = np.logaddexp(0, out[BATCH:]).mean() - prior * np.logaddexp(0, out[:BATCH]).mean()
            if negative >= 0:
                slope = np.concatenate([prior * (on_p - 1) - prior * on_p, on_u]) / BATCH
            else:
                slope = np.concatenate([prior * on_p, -on_u]) / BATCH
        net.descend(x, hidden, slope, rate=0.01 if step < steps * 2 // 3 else 0.002)
    return net


def cuts(own: np.ndarray) -> np.ndarray:
    """Where the tails of two distributions of scores are compared: quantiles of those of held-back positives."""
    return np.quantile(own, np.linspace(0, 0.9, CUTS))


def prior_of_tails(own: np.ndarray, above: np.ndarray, n: int) -> float:
    """The least ratio of the tails: ``above`` of ``n`` unlabelled scores reach each of the ``cuts`` of ``own``. The sampling error is added before they are compared."""
    tail_p = 1 - np.searchsorted(np.sort(own), cuts(own)) / len(own)
    tail_u = above / n
    error = np.sqrt(0.5 * np.log(40) / n) + np.sqrt(0.5 * np.log(40) / len(own))
    best = int(np.argmin((tail_u + error) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives among unlabelled rows in memory."""
    net = fit(positive[::2], unlabelled[::2], None, seed, STEPS // 2)
    own, other = (net.forward(x)[1] for x in (positive[1::2], unlabelled[1::2]))
    return prior_of_tails(own, (other[:, None] >= cuts(own)).sum(0), len(other))


def _tails(weights: list[np.ndarray], centre: np.ndarray, scale: np.ndarray, at: np.ndarray):
    """Texts to counts by the number of cuts that their score reaches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(at) + 1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.clip((np.array([quality_features(t or "") for t in batch.column(0).to_pylist()]) - centre) / scale, -8, 8)
                out = np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3][0]
                held += np.bincount(np.searchsorted(at, out, side="right"), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held)], names=["reached", "texts"])

    return count


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([quality_features(t or "") for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["trusted", "sampled", "features"])


def _scores(nets: list[list[np.ndarray]], centre: np.ndarray, scale: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total = np.zeros(len(texts))
            if texts and nets:
                x = np.clip((np.array([quality_features(t or "") for t in texts]) - centre) / scale, -8, 8)
                for w in nets:
                    total += sigmoid(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0]) / len(nets)
            elif texts:
                total += 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], names=["row", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, unlabelled: int = UNLABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(row, held_out, score, predicted, learned) for each row of ``docs``; ``row`` is the row itself."""
    small_batches(docs.sparkSession)
    trusted = learnable(labels, "quality", DIVISOR, HELD_OUT, limit, only=1).select("doc_id", F.lit(True).alias("trusted"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sampled = share(F.coalesce("doc_id", F.xxhash64("text")), unlabelled / max(1, texts.count()), 3)
    # ``trusted`` has about ``limit`` rows, so its broadcast is bounded, and so is what comes back.
    marked = texts.join(F.broadcast(trusted), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), sampled.alias("sampled"), "text")
    known = marked.where("trusted or sampled").mapInArrow(_features, "trusted boolean, sampled boolean, features array<double>").toPandas()
    nets, centre, scale = [], np.zeros(1), np.ones(1)
    if known["trusted"].sum() >= LEAST_EXAMPLES:
        x = np.array(known["features"].tolist())
        order = np.lexsort(x.T)  # rows arrive in any order
        x, trusts, samples = x[order], known["trusted"].to_numpy()[order], known["sampled"].to_numpy()[order]
        centre, scale = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - centre) / scale, -8, 8)
        mixed = np.random.default_rng(11).permutation(len(x))
        positive, others = x[mixed][trusts[mixed]], x[mixed][samples[mixed]]
        apart = fit(positive[::2], others, None, 5, STEPS // 2)
        own = apart.forward(positive[1::2])[1]
        tails = texts.select("text").mapInArrow(_tails(apart.weights, centre, scale, cuts(own)), "reached int, texts long").groupBy("reached").agg(F.sum("texts").alias("texts"))
        held = np.zeros(CUTS + 1)
        for r in tails.collect():  # one row for each number of cuts
            held[r["reached"]] = r["texts"]
        prior = prior_of_tails(own, held[::-1].cumsum()[::-1][1:], held.sum())
        nets = [fit(positive, others, prior, seed).weights for seed in (21, 22, 23)]
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scores(nets, centre, scale), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    held_out = F.coalesce(fold(f"row.{id_col}", DIVISOR) == HELD_OUT, F.lit(False))
    scored = scored.select("row", held_out.alias("held_out"), "score")
    return scored.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "learned": F.lit(bool(nets))})
