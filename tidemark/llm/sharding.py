"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 to n - 1 without a global sort: a hash deals them to buckets, the counts of the buckets give
each bucket's first number, and rows are numbered within their bucket. A Feistel network over two numbers, mixed radix, permutes a
domain just over n; numbers that leave 0 to n - 1 walk on until they are back. The place so found gives the shard (place
modulo shards) and the slot (place divided by shards), so counts differ by one at most and a row's home can be computed.

Rows are distinguished by id, size and text hash; equal rows are counted together before they are dealt out, so a
group of copies is no hot key. Nulls and odd rows: a null text has no bytes of its own and the checksum of an empty one; null ids are dealt like
others; repeated rows get places of their own, and so do ties; a very long text counts by its size and checksum only, since laws go by counts; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle

ROUNDS = 4
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Row numbers start from the counts of this many hash buckets.
BUCKETS = 8192
#: Copies of one row that one number range holds together.
RUN = 4096
#: Radices that are tried for a small rest.
TRIED = 512


def _sides(n: int) -> tuple[int, int]:
    """Two radices near the root of n whose product is n or little more: the numbers over n are what cycle walking passes."""
    root = max(1, math.isqrt(max(0, n - 1)) + 1)
    a = min(range(root, root + min(TRIED, root)), key=lambda a: -n % a)
    return a, max(1, -(-n // a))


def _round(x: Column, k: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(k), F.lit(seed)), F.lit(modulus))


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass through the network: a bijection of 0 to a * b - 1."""
    left, right = F.call_function("div", x, F.lit(b)), F.pmod(x, F.lit(b))
    for k in range(ROUNDS):
        if k % 2:
            right = F.pmod(right + _round(left, k, seed, b), F.lit(b))
        else:
            left = F.pmod(left + _round(right, k, seed, a), F.lit(a))
    return left * F.lit(b) + right


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` among n: a bijection of 0 to n - 1.

    Few numbers leave the range, at most one in the square root of n; as many steps as there are numbers outside bring any of them back.
    """
    a, b = _sides(n)
    once = _once(x, a, b, seed)
    if a * b == n:
        return once
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once, lambda p, _: F.when(p < n, p).otherwise(_once(p, a, b, seed)))
    return F.when(once < n, once).otherwise(walk)


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) for each row."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash"),
    )
    own = ["doc_id", "size", "text_crc32", "text_hash"]
    same = settle(rows.groupBy(*own).agg(F.count("*").alias("copies")), "rows")
    n = same.agg(F.sum("copies")).first()[0] or 0
    runs = F.sequence(F.lit(0), F.call_function("div", F.col("copies") - 1, F.lit(RUN)).cast("int"))
    dealt = same.select(*own, "copies", F.explode(runs).alias("run"))
    dealt = dealt.withColumns({"copies": F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN), "bucket": F.pmod(F.xxhash64("doc_id", "text_hash", "run"), F.lit(BUCKETS))})
    # At most BUCKETS rows from here to the broadcast.
    counts = dealt.groupBy("bucket").agg(F.sum("copies").alias("held"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("bucket").orderBy(*own, "run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("at", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(firsts), "bucket")
    number = F.col("first") + F.col("at") + F.col("copy")
    numbered = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("row_number", number)
    placed = numbered.withColumn("place", permuted(F.col("row_number"), max(1, n), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).alias("slot"),
    )
