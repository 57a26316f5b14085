"""Compress vectors to product codes by rounds of Lloyd's method whose nearest-entry search is the exponion search, all in whole numbers.

Components become ``floor(4096 * x)`` and each vector is cut into eight parts; each part position has a codebook of 16 entries. A round finds every part's
nearest entry and moves each entry to the floored mean of its parts. The search for a part starts at the entry that it had in the round before, at squared
distance u: an entry j at most as far from the part as that one lies, by the triangle inequality, within twice its distance, so its squared distance to the start
is at most 4 u. The other entries are scanned in the order of their distance to the start and the scan ends beyond that radius; nothing nearer, and nothing equally near, is missed.

A round is one pass over a written table: tasks write each vector with its new code beside their own sums and counts of the parts of each entry,
and only those sums, added up by Spark, reach the driver (128 entries at most). A table of the round before is deleted. Where a round moves no entry, all later ones
would give the same, and none is run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle
from tidemark.scratch import forget, package_shipped

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components of this size and more count as not finite, so that whole numbers fit 64 bits and their sums 38 digits.
LARGEST = float(1 << 50)
#: Below this size (of whole components) squared distances of parts of up to 8192 components fit 64 bits; beyond, Python's own integers are used.
SMALL = 1 << 24
_LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(id, label, ints) of the vectors that are kept."""
    x = F.col(vector_col)
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)), F.lit(False))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    return vectors.where(sound & (F.size(x) > 0) & (F.size(x) % parts == 0)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), ints.alias("ints"))


def _numbers(rows: np.ndarray) -> np.ndarray:
    """64-bit integers where squares of their differences fit, Python's integers else."""
    return rows if not rows.size or int(max(rows.max(), -rows.min())) < SMALL else rows.astype(object)


class Codebook:
    """The entries of one part position with the other entries of each in the order of their distance."""

    def __init__(self, entries: list[list[int]]):
        self.entries = _numbers(np.array(entries, dtype=np.int64))
        self.between = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(self.between, axis=1, kind="stable")
        n = len(entries)
        self.others = np.array([[j for j in order[k] if j != k] for k in range(n)], dtype=np.int64).reshape(n, n - 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` (the lowest of equally near ones) and its squared distance, searched from ``start``."""
        x, entries = _numbers(x), self.entries
        if x.dtype == object or entries.dtype == object:
            x, entries = x.astype(object), entries.astype(object)
        u = ((x - entries[start]) ** 2).sum(axis=1)
        best, least = start.copy(), u.copy()
        inside = np.arange(len(x))
        for k in range(self.others.shape[1]):
            other = self.others[start[inside], k]
            near = (self.between[start[inside], other] <= 4 * u[inside]).astype(bool)
            inside, other = inside[near], other[near]
            if not len(inside):
                break
            d = ((x[inside] - entries[other]) ** 2).sum(axis=1)
            won = ((d < least[inside]) | ((d == least[inside]) & (other < best[inside]))).astype(bool)
            best[inside[won]], least[inside[won]] = other[won], d[won]
        return best, least


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    ints = batch.column("ints")
    return ints.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, parts).astype(np.int64)


def _assigned(batch: pa.RecordBatch, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, before = _rows(batch), _codes(batch, len(books))
    after, errors, width = np.empty_like(before), np.zeros(len(x), dtype=object), x.shape[1] // len(books)
    for p, book in enumerate(books):
        after[:, p], d = book.nearest(x[:, p * width : (p + 1) * width], before[:, p])
        errors = errors + d
    return x, after, errors


def _packed(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())


def _round(entries: list[list[list[int]]], sums_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector with its new code; at a task's end the count and sum of its parts of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        n, width = len(entries[0]), len(entries[0][0])
        counts = np.zeros((len(books), n), dtype=np.int64)
        sums = np.zeros((len(books), n, width), dtype=object)
        empty = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes, _ = _assigned(batch, books)
            small = np.abs(x).max() < 1 << 40  # then a batch's sums fit 64 bits
            for p in range(len(books)):
                part = x[:, p * width : (p + 1) * width]
                for k in np.unique(codes[:, p]):
                    own = part[codes[:, p] == k]
                    counts[p, k] += len(own)
                    sums[p, k] += own.sum(axis=0).astype(object) if small else own.astype(object).sum(axis=0)
            empty = batch
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), sums_type)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("ints"), _packed(codes), *none], _NAMES)
        if empty is not None:
            at = [(p, k) for p in range(len(books)) for k in range(n) if counts[p, k]]
            none = [pa.nulls(len(at), empty.column(c).type) for c in ("id", "label", "ints")]
            totals = pa.array([[Decimal(int(v)) for v in sums[p, k]] for p, k in at], sums_type)
            made = [pa.array([p for p, _ in at], pa.int32()), pa.array([k for _, k in at], pa.int32()), pa.array([int(counts[p, k]) for p, k in at], pa.int64()), totals]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(len(at), pa.binary()), *made], _NAMES)

    return run


_NAMES = ["id", "label", "ints", "code", "part", "entry", "n", "total"]


def _last(entries: list[list[list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        for batch in batches:
            if batch.num_rows:
                _, codes, errors = _assigned(batch, books)
                text = pa.array(["".join(f"{c:02x}" for c in row) for row in codes], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), text, pa.array([min(int(e), _LONGEST) for e in errors], pa.int64())], ["id", "label", "code", "error"])

    return run


def _written(entries: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for book in entries for entry in book for v in entry).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), a row for each vector that is kept; the id has its own column's name.

    Left out are vectors that are null, empty, hold a null or a component that is not finite (2**50 and more counts as such), or have a length that ``parts`` doesn't divide or
    that is not the length of the first kept vector. Codebooks start from the smallest ids, null ids last, rows that share an id in the order of their components; where fewer than
    ``entries`` vectors are kept there are as many entries as vectors. Repeated rows count each. Equally near entries: the lowest. Vectors of any length are read whole.
    Null labels are one group. Sums of errors beyond 64 bits stay at the largest long. An empty table gives an empty table. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    package_shipped(spark)
    kept = whole_vectors(vectors, id_col, vector_col, label_col, parts)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(1).select(F.size("ints").alias("width")).collect()
    out = [id_col, "code", "error", "label_error", "codebooks_sha256"]
    if not seeds:
        id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
        none = spark.createDataFrame([], f"id {id_type}, label {label_type}, code string, error long")
        return none.select(F.col("id").alias(id_col), "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256")).toDF(*out)
    kept = kept.where(F.size("ints") == seeds[0]["width"])
    first = [r["ints"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
    width = seeds[0]["width"] // parts
    books = [[list(v[p * width : (p + 1) * width]) for v in first] for p in range(parts)]
    start = kept.withColumn("code", F.lit(bytes(parts)))
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"id {id_type}, label {label_type}, ints array<bigint>, code binary, part int, entry int, n bigint, total array<decimal(38,0)>"
    sums_type = pa.list_(pa.decimal128(38, 0))
    now, written = start, None
    for _ in range(rounds):
        made = settle(now.mapInArrow(_round(books, sums_type), schema), "codes")
        if written is not None:
            forget(written)
        written, now = made, made.where("part is null").select("id", "label", "ints", "code")
        totals = made.where("part is not null").select("part", "entry", "n", F.posexplode("total").alias("place", "sum")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        moved = [[list(e) for e in book] for book in books]
        for r in totals.collect():
            moved[r["part"]][r["entry"]][r["place"]] = int(r["sum"]) // r["n"]
        still, books = moved == books, moved
        if still:
            break
    coded = settle(now.mapInArrow(_last(books), f"id {id_type}, label {label_type}, code string, error bigint"), "coded")
    if written is not None:
        forget(written)
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONGEST))).cast("long").alias("label_error"))
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(_written(books)).alias("codebooks_sha256"))
