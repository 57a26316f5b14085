"""Mine phrases whose words occur together more often than apart, per language, from depth-limited count tries.

Tasks build a trie of all runs of words for each shard of about ``SHARD`` words of a language, cut it at splitters and send the serialised, sorted parts to the ranges of paths;
each range merges its parts and walks the sum: the walk knows the counts of all beginnings of a phrase (its left parts). The right parts are
the counts along the suffix links, from a phrase to the same phrase without its first word, which are joins of a level with the one above it. Splitters are taken from
a sample of the nodes, so a range has about ``NODES`` of them, whatever words are frequent; a frequent word's subtree is cut like anything else. They only divide the work.

Words are 64-bit hashes inside tries. All words are also listed, and a hash that two words of a language share would be found there; then everything is done again with another
seed, so counts are those of the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, lowered, mix, settle, small_batches, word_mask, word_spans
from tidemark.llm.labelled import share
from tidemark.llm.tries import Path, Trie, built, cut, merged, owned, walked
from tidemark.scratch import forget

LONGEST = 3
LEAST = 10
TOP = 2000
#: A candidate goes if a longer one around it has at least this percentage of its occurrences.
PERCENT = 50
#: Words of a shard, and nodes of shards' tries that meet in one range. They divide work, not results.
SHARD = 2_000_000
NODES = 3_000_000
#: One node in so many is a sample for the splitters; the driver gets about SAMPLES of these at most.
RATE = 20_000
SAMPLES = 200_000
#: Parts of a language that are ranked by themselves before its best are.
PARTS = 64
#: ``.,;:!?`` and the controls 10 to 13 end a piece; space and tab end a word.
BREAKS = (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = word_mask((0x20, 0x09, *BREAKS))
_BREAKS = ~word_mask(BREAKS)


class Shards:
    """Words of each language of a task, given out in shards."""

    def __init__(self, seed: int, spell: bool):
        self.seed, self.spell = seed, spell
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, list[np.ndarray]] = defaultdict(list)
        self.joined: dict[str, list[np.ndarray]] = defaultdict(list)
        self.known: dict[str, dict[int, bytes]] = defaultdict(dict)
        self.n = 0

    def take(self, texts: pa.Array, langs: list[str]) -> None:
        raw, starts = buffers(texts)
        hashes, row, at, length = word_spans(raw, starts, _IS_WORD, self.seed)
        if not len(hashes):
            return
        hashes[hashes == 0] = 1
        breaks = np.cumsum(_BREAKS[raw])[at]
        joined = np.zeros(len(hashes), dtype=bool)
        joined[1:] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        names, of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        for k, lang in enumerate(names):
            own = np.flatnonzero((of == k)[row])  # whole rows, so neighbours in a row stay neighbours
            if len(own):
                self.words[lang].append(hashes[own])
                self.joined[lang].append(joined[own])
                if self.spell:
                    text, known = lowered(raw), self.known[lang]
                    for h, w in zip(*np.unique(hashes[own], return_index=True), strict=True):
                        if int(h) not in known:
                            known[int(h)] = text[at[own[w]] : at[own[w]] + length[own[w]]]
        self.n += len(hashes)

    def given(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, dict[int, bytes]]]:
        for lang in self.words:
            yield lang, np.concatenate(self.words[lang]), np.concatenate(self.joined[lang]), self.known[lang]
        self.clear()


def _shards(batches: Iterator[pa.RecordBatch], seed: int, spell: bool, size: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, dict[int, bytes]]]:
    held = Shards(seed, spell)
    for batch in batches:
        held.take(batch.column("text"), batch.column("lang").to_pylist())
        if held.n >= size:
            yield from held.given()
    yield from held.given()


def _sampled(hashes: np.ndarray, joined: np.ndarray, depth: int) -> np.ndarray:
    """A row of hashes (0 where the path has ended) for about one in RATE different paths, the same ones in all shards."""
    found, path, can = [], mix(hashes), np.ones(len(hashes), dtype=bool)
    for k in range(depth):
        if k:
            can = can[:-1] & joined[k:]
            path = mix(path[:-1] + hashes[k:] * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(can & (path % np.uint64(RATE) == 0))
        rows = np.zeros((len(at), depth), dtype=np.uint64)
        for j in range(k + 1):
            rows[:, j] = hashes[at + j]
        found.append(rows)
    return np.unique(np.concatenate(found), axis=0)


_LIST = "lang string, hash bigint, word string, path array<bigint>, n bigint"


def _listed(seed: int, depth: int, size: int):
    """The different words of each shard, a sample of its paths and, in a row of its own, the number of its nodes as far as these tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, hashes, joined, known in _shards(batches, seed, True, size):
            words = pa.array(list(known.values()), pa.binary()).cast(pa.string())
            keys = pa.array(np.fromiter(known, dtype=np.uint64, count=len(known)).view(np.int64))
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), keys, words, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], ["lang", "hash", "word", "path", "n"])
            paths = _sampled(hashes, joined, depth)
            n = len(paths)
            lists = pa.array([[int(v) for v in p.view(np.int64)] for p in paths], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), lists, pa.array([1] * n, pa.int64())], ["lang", "hash", "word", "path", "n"])

    return run


def _cut(seed: int, depth: int, size: int, splitters: dict[str, list[Path]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, hashes, joined, _ in _shards(batches, seed, False, size):
            parts = cut(built(hashes, joined, depth), splitters.get(lang, []))
            for place in range(0, len(parts), 64):
                some = parts[place : place + 64]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.array([k for k, _ in some], pa.int32()), pa.array([d for _, d in some], pa.binary())], ["lang", "part", "trie"])

    return run


_NODE = "lang string, path array<bigint>, a bigint, lefts array<bigint>"


def _merge(least: int, splitters: dict[str, list[Path]]):
    """The frequent nodes of a range; a path without words carries the number of all words whose node lies in it."""

    def run(key: tuple, held: pa.Table) -> pa.Table:
        lang, part = key[0].as_py(), key[1].as_py()
        first = splitters[lang][part - 1] if part else ()
        trie: Trie = merged(held.column("trie").to_pylist())
        paths, counts, lefts = [pa.array([[]], pa.list_(pa.int64()))], [np.array([owned(trie, first)], dtype=np.int64)], [pa.array([[]], pa.list_(pa.int64()))]
        for p, c, before in walked(trie, first, least):
            counts.append(c)
            for made, rows in ((paths, p.view(np.int64)), (lefts, before)):
                made.append(pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32), pa.array(rows.ravel())))
        flat = np.concatenate(counts)
        return pa.table([pa.repeat(lang, len(flat)), pa.chunked_array(paths).combine_chunks(), pa.array(flat), pa.chunked_array(lefts).combine_chunks()], ["lang", "path", "a", "lefts"])

    return run


def _splitters(sampled: DataFrame, nodes: int) -> dict[str, list[Path]]:
    """For each language the paths at which ranges of about ``nodes`` nodes begin."""
    n = sampled.count()
    part = min(1.0, SAMPLES / max(1, n))
    rows = sampled.where(share(F.to_json(F.struct("lang", "path")), part, 7)).groupBy("lang", "path").agg(F.count("*").alias("n")).collect()
    paths: dict[str, list[tuple[Path, int]]] = defaultdict(list)
    for r in rows:
        paths[r["lang"]].append((tuple(v % (1 << 64) for v in r["path"] if v), r["n"]))
    every, found = nodes * part / RATE, {}
    for lang, held in paths.items():
        room, found[lang] = every, []
        for path, weight in sorted(held):
            room -= weight
            if room <= 0:
                found[lang].append(path)
                room = every
    return found


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard: int = SHARD, nodes: int = NODES, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Two written tables: nodes (lang, path, a, lefts) that occur ``least`` times, with the count of all words at the empty paths; words (lang, hash, word)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    for seed in range(1 << 30):
        listed = settle(texts.mapInArrow(_listed(seed, longest, shard), _LIST), "listed")
        words = settle(listed.where("word is not null").select("lang", "hash", "word").repartition("lang", "hash").dropDuplicates(), "words")
        if words.groupBy("lang", "hash").count().where("count > 1").isEmpty():
            break
        forget(words)
        forget(listed)
    splitters = _splitters(listed.where("path is not null").select("lang", "path"), nodes)
    forget(listed)
    parts = texts.mapInArrow(_cut(seed, longest, shard, splitters), "lang string, part int, trie binary")
    return settle(parts.groupBy("lang", "part").applyInArrow(_merge(least, splitters), _NODE), "nodes"), words


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), in whole numbers of up to 38 digits."""
    big = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", (big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (big[1] * big[2]).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = PERCENT, shard: int = SHARD, nodes: int = NODES, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to ``longest`` words that occur ``least`` times.

    A phrase's score is that of its lowest-scoring cut, ties to the first; it goes if a longer candidate around it has ``percent`` of its occurrences.
    Ties of the ranking go by occurrences and then by the phrase's bytes. A null text has no words, a null language is ``und``, repeated rows count each; texts of any length
    are counted whole, and a text without words adds nothing. An empty table gives an empty table. Columns other than the two are not read, whatever their names.
    """
    found, words = counted(docs, longest, least, shard, nodes, text_col, lang_col)
    level = found.where(F.size("path") == 1).select("lang", "path", "a", F.col("path")[0].alias("hash")).join(words, ["lang", "hash"])
    level = level.select("lang", "path", "a", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array().cast("array<bigint>").alias("rights"))
    levels = []
    for k in range(2, longest + 1):
        begin = level.select("lang", F.col("path").alias("begin"), F.col("phrase").alias("before"))
        link = level.select("lang", F.col("path").alias("link"), "last", F.concat(F.array("a"), "rights").alias("rights"))
        own = found.where(F.size("path") == k).select("lang", "path", "a", "lefts", F.slice("path", 1, k - 1).alias("begin"), F.slice("path", 2, k - 1).alias("link"))
        level = own.join(begin, ["lang", "begin"]).join(link, ["lang", "link"])
        level = settle(level.select("lang", "path", "a", "lefts", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "rights"), f"phrases-{k}")
        levels.append(level)
    kept = None
    for k, level in enumerate(levels, 2):
        cuts = [F.struct(_score(F.col("a"), F.col("lefts")[j], F.col("rights")[j]).alias("score"), F.lit(j).alias("j"), F.col("lefts")[j].alias("l"), F.col("rights")[j].alias("r")) for j in range(k - 1)]
        scored = level.select("lang", "path", "phrase", "a", (F.least(*cuts) if k > 2 else cuts[0]).alias("cut"))
        if k < longest:
            longer = levels[k - 1].select("lang", F.explode(F.array(F.slice("path", 1, k), F.slice("path", 2, k))).alias("path"), F.col("a").alias("around"))
            scored = scored.join(longer.groupBy("lang", "path").agg(F.max("around").alias("around")), ["lang", "path"], "left")
            whole = [F.col(c).cast("decimal(19,0)") for c in ("around", "a")]
            scored = scored.where(F.col("around").isNull() | (whole[0] * 100 < whole[1] * percent))
        scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        kept = scored if kept is None else kept.unionByName(scored)
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))  # the best of each part first, so no task ranks all phrases of a language
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = found.where(F.size("path") == 0).groupBy("lang").agg(F.sum("a").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
