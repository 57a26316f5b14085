"""What the operators of this subpackage share: bounded Arrow batches and word hashing on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import kept as settle  # noqa: F401  the operators take it from here
from tidemark.scratch import package_shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Give the workers this package, and bound the Arrow batches by rows and bytes, so that long texts cannot fill a worker's memory."""
    package_shipped(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception:  # noqa: BLE001  this Spark has no such setting
        return


def fold(doc_id: str, divisor: int):
    """crc32 of the id as text modulo ``divisor``: the split between rows whose labels are learned and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


# ---------------------------------------------------------------------------------------------------------------
# Bytes and words of a whole Arrow batch

#: The bytes between words: space and the controls 9 to 13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(2 * n, _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column on end, and where each row begins (one more entry for the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def word_mask(separators: tuple[int, ...]) -> np.ndarray:
    """For each byte whether it belongs to words."""
    mask = np.ones(256, dtype=bool)
    mask[list(separators)] = False
    return mask


def word_spans(raw: np.ndarray, starts: np.ndarray, mask: np.ndarray = _IS_WORD, seed: int = 0, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, each word's row, its first byte and its number of bytes.

    Bytes are worked through in pieces that end between words, so that the memory of the arithmetic doesn't grow with a text.
    """
    found, a = [], 0
    while a < len(raw):
        b = min(len(raw), a + piece)
        while b < len(raw) and mask[raw[b]]:  # to the end of this word, or beyond a row's end to the end of the next one: no harm
            ends = np.flatnonzero(~mask[raw[b : b + 4096]])
            b += int(ends[0]) if len(ends) else len(raw[b : b + 4096])
        hashes, row, at, length = _spans(raw[a:b], np.clip(starts, a, b) - a, mask, seed)
        found.append((hashes, row, at + a, length))
        a = b
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _spans(raw: np.ndarray, starts: np.ndarray, mask: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    word = mask[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[:-1][starts[:-1] < len(raw)]
    first[edges] |= word[edges]
    at = np.flatnonzero(first)
    if not len(at):
        return none
    chars = _LOWER[raw[word]].astype(np.uint64)
    begin = np.flatnonzero(first[word])
    length = np.diff(np.append(begin, len(chars)))
    place = np.arange(len(chars)) - np.repeat(begin, length)
    summed = np.add.reduceat((chars + np.uint64(1)) * _powers(int(length.max()))[place], begin)
    summed += np.uint64(seed * int(_MIX_1) & (1 << 64) - 1)
    return mix(summed + length.astype(np.uint64) * _MIX_2), np.searchsorted(starts, at, side="right") - 1, at, length


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each word's row."""
    return word_spans(raw, starts)[:2]


def lowered(raw: np.ndarray) -> bytes:
    """The bytes with A-Z lower-cased."""
    return _LOWER[raw].tobytes()


def shingle_hashes(raw: np.ndarray, starts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each row's set of ``width``-word shingles as sorted distinct 64-bit hashes.

    A row with fewer words has its whole word sequence as its one shingle; a row without words has none.
    """
    hashes, row = word_hashes(raw, starts)
    n = len(starts) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = rolled * _BASE + hashes[k : len(hashes) - width + 1 + k]
    rolled = mix(rolled)
    sets = []
    for k in range(n):
        a, b = first[k], first[k + 1]
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for x in range(a, b):
                short = short * _BASE + hashes[x]
            sets.append(mix(short + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
