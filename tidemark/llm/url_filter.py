"""URL filters on a sorted digest array.

A list of rules (host, path, verdict) becomes a file: the sorted 64-bit xxhash keys of the strings host + path, with the
strings themselves behind them. Spark ships the file to every executor; tasks map it into memory, probe the
candidates of a whole batch by vectorised binary search, and confirm a hit against the stored string, so colliding
keys do no harm. A url's candidates are those of its host and parent domains that have as many labels as some rule's host, each with the starts of its
path that are as long as some rule's path: their number depends on the rules, not on the url. A list whose file would be over a bound of bytes is dealt by ranges
of the keys instead: each range is a sorted array of at most about that size, mapped by the task that the range's different candidates go to, and probed and confirmed in the same way.

Nulls, ties and odd rows: a null url, or one without ``://``, has an empty host and path and fits no rule; of several rules that
fit the longest string wins, and the first listed of equal strings (in a DataFrame of rules, allow before block); a rule without host, or
whose path begins otherwise than by ``/``, fits nothing, a null path is an empty one; urls of any length are judged whole, repeated ones each; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import mmap
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.scratch import stored

#: Spark's xxhash64 has this seed.
SEED = 42
#: Bytes of one mapped array; larger lists are dealt by key ranges.
MAX_FILE = 64 << 20
#: Each string that is listed and found meets its urls in so many groups, since one domain may be that of a third of all urls.
SALTS = 16


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed=SEED)


def write_digests(rules: Sequence[Rule]) -> bytes:
    """The file: a count; keys in order; where each string begins; whether it blocks; the strings."""
    first: dict[str, Rule] = {}
    for rule in rules:
        first.setdefault(rule.host + rule.path, rule)
    order = sorted(first, key=lambda s: (digest(s), s))
    heap = [s.encode() for s in order]
    keys = np.array([digest(s) for s in order], dtype="<u8")
    begin = np.concatenate(([0], np.cumsum([len(s) for s in heap]))).astype("<u8")
    blocks = np.array([first[s].verdict == "block" for s in order], dtype=np.uint8)
    return np.array([len(order)], dtype="<u8").tobytes() + keys.tobytes() + begin.tobytes() + blocks.tobytes() + b"".join(heap)


class Digests:
    """The bytes of ``write_digests``, mapped from a file or from memory."""

    def __init__(self, source) -> None:
        whole = np.frombuffer(source, dtype=np.uint8) if isinstance(source, mmap.mmap) else np.memmap(source, dtype=np.uint8, mode="r")
        n = int(whole[:8].view("<u8")[0])
        self.keys = whole[8 : 8 + 8 * n].view("<u8")
        self.begin = whole[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.blocks = whole[16 + 16 * n : 16 + 17 * n]
        self.heap = whole[16 + 17 * n :]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are listed."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def confirm(self, key: np.uint64, string: str) -> int:
        """The place of a string whose key is listed, or -1 if only other strings have that key."""
        for place in range(int(np.searchsorted(self.keys, key)), len(self.keys)):
            if self.keys[place] != key:
                break
            if self.string(place) == string:
                return place
        return -1

    def string(self, place: int) -> str:
        return self.heap[int(self.begin[place]) : int(self.begin[place + 1])].tobytes().decode()


@functools.lru_cache(8)
def _mapped(name: str) -> Digests:
    return Digests(SparkFiles.get(name))


def _ship(spark: SparkSession, data: bytes) -> str:
    """Put the file into the shared folder and have Spark bring it to the executors."""
    name = f"digests-{xxhash.xxh128_hexdigest(data)}-{uuid.uuid4().hex[:8]}.bin"
    spark.sparkContext.addFile(stored(spark, name, data))
    return name


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _candidates(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """The domains of the host with ``depths`` labels, each with the starts of the path of ``lengths`` characters."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    domains = F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in depths)))
    starts = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.when(host != "", F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p))))).otherwise(F.array().cast("array<string>"))


def _probe(name: str):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _mapped(name)
        for batch in batches:
            keys, lists = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            strings = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            probes = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hits = np.flatnonzero(digests.probe(probes))
            wanted = strings.take(pa.array(hits)).to_pylist()
            places = np.array([digests.confirm(probes[k], text) for k, text in zip(hits, wanted, strict=True)], dtype=np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)[hits]
            best: dict[int, int] = {}
            for r, p in zip(row[places >= 0].tolist(), places[places >= 0].tolist(), strict=True):
                if r not in best or digests.begin[p + 1] - digests.begin[p] > digests.begin[best[r] + 1] - digests.begin[best[r]]:
                    best[r] = p
            rules = [digests.string(best[r]) if r in best else None for r in range(len(sizes))]
            verdicts = [("block" if digests.blocks[best[r]] else "allow") if r in best else None for r in range(len(sizes))]
            columns = [*batch.columns[:-2], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "rule", "verdict"])

    return probe


def _in_memory(data: bytes) -> Digests:
    place = mmap.mmap(-1, len(data))
    place.write(data)
    return Digests(place)


def _probe_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(candidate, verdict) of candidates that are listed, from rows in order of range, with its rules before its candidates."""
    current, rules, digests = None, [], None
    for batch in batches:
        ranges, probing = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = (np.flatnonzero(np.diff(ranges) | np.diff(probing)) + 1).tolist()
        found, verdicts = [], []
        for begin, end in zip([0, *cuts], [*cuts, len(ranges)], strict=True):
            if begin == end:
                continue
            if ranges[begin] != current:
                current, rules, digests = ranges[begin], [], None
            piece = batch.slice(begin, end - begin)
            if not probing[begin]:
                rules += [Rule(text, "", verdict) for text, verdict in zip(piece.column(3).to_pylist(), piece.column(4).to_pylist(), strict=True)]
                continue
            if digests is None:
                digests, rules = _in_memory(write_digests(rules)), []
            keys = piece.column(2).to_numpy().view(np.uint64)
            hits = np.flatnonzero(digests.probe(keys))
            for k, text in zip(hits, piece.column(3).take(pa.array(hits)).to_pylist(), strict=True):
                place = digests.confirm(keys[k], text)
                if place >= 0:
                    found.append(text)
                    verdicts.append("block" if digests.blocks[place] else "allow")
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["candidate", "verdict"])


def _by_ranges(split: DataFrame, listed: DataFrame, size: int, max_file: int) -> DataFrame:
    """The same for a list of any size: its array is cut by key ranges, each probed by the different candidates of that range."""
    bits = min(16, max(0, math.ceil(math.log2(max(1, size / max(1, max_file))))))
    at = lambda key: F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
    urls = split.select("host", "path", "candidates", "keys").distinct()
    probes = urls.select(F.explode(F.arrays_zip("keys", "candidates")).alias("c")).select(F.col("c.keys").alias("key"), F.col("c.candidates").alias("text")).distinct()
    key = F.xxhash64("rule")
    rows = listed.select(at(key).alias("range"), F.lit(0).alias("probing"), key.alias("key"), F.col("rule").alias("text"), "verdict")
    rows = rows.unionByName(probes.select(at(F.col("key")).alias("range"), F.lit(1).alias("probing"), "key", "text", F.lit(None).cast("string").alias("verdict")))
    hits = rows.repartition("range").sortWithinPartitions("range", "probing").mapInArrow(_probe_ranges, "candidate string, verdict string")
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wanted = urls.select("host", "path", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("candidates").alias("candidate"))
    best = wanted.join(hits, ["candidate", "salt"]).groupBy("host", "path").agg(F.max_by(F.struct(F.col("candidate").alias("rule"), "verdict"), F.length("candidate")).alias("b"))
    return split.select("page_id", "host", "path").join(best, ["host", "path"], "left").select("page_id", "host", "path", "b.rule", "b.verdict")


def _table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """(host, path, verdict) of different strings host + path."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], "host string, path string, verdict string, place long")
    else:
        rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict", (F.col("verdict") == "block").cast("long").alias("place"))
    first = rules.where("host <> '' and (path = '' or startswith(path, '/'))").groupBy(F.concat("host", "path").alias("rule")).agg(F.min_by(F.struct("host", "path", "verdict"), F.struct("place", "host")).alias("r"))
    return first.select("rule", "r.*")


def judge(
    pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_file: int = MAX_FILE
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row: the longest rule that fits, else null and ``default``.

    ``rules`` is a sequence or a DataFrame of host, path and verdict.
    """
    spark = pages.sparkSession
    small_batches(spark, rows=5000)
    listed = None
    if isinstance(rules, DataFrame):
        listed = _table(spark, rules)
        labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
        facts = listed.agg(F.collect_set(labels), F.collect_set(F.length("path")), F.coalesce(F.sum(F.octet_length("rule") + 17), F.lit(0))).first()
        depths, lengths, size = sorted(facts[0]) or [1], sorted(facts[1]) or [0], facts[2]
        if size <= max_file:
            rules = [Rule(*r) for r in listed.select("host", "path", "verdict").collect()]  # of a size that was measured
    else:
        rules = [r for r in rules if r.host and r.path[:1] in ("", "/")]
        depths, lengths = sorted({r.host.count(".") + 1 for r in rules}) or [1], sorted({len(r.path) for r in rules}) or [0]
        size = sum(len((r.host + r.path).encode()) + 17 for r in rules)
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    split = split.withColumn("candidates", _candidates(F.col("host"), F.col("path"), depths, lengths))
    split = split.withColumn("keys", F.transform("candidates", lambda s: F.xxhash64(s)))
    if size <= max_file:
        kind = split.schema["page_id"].dataType.simpleString()
        found = split.mapInArrow(_probe(_ship(spark, write_digests(rules))), f"page_id {kind}, host string, path string, rule string, verdict string")
    else:
        found = _by_ranges(split, listed if listed is not None else _table(spark, rules), size, max_file)
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
