"""Score texts by a weighted backoff automaton over all n-grams of the training texts.

A text is its words, A-Z lower-cased, and one end token, read after a start mark. Counts are smoothed by a Dirichlet prior on the next shorter context:
``p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m)``, where h' is h without its first word; the shortest distribution adds one to every count and keeps one share for unknown words. So all probabilities of a context sum to one.
Contexts that occur are states. A state has an arc for each word that follows it, which weighs log10 p and leads to the longest known context that then
ends the text so far, and a failure arc to h' that weighs log10 of m / (c(h) + m). A text is read once from left to right: its state is carried, failure arcs are taken until the word has an arc, weights add up.

No model is held whole anywhere. Texts form blocks of about ``BLOCK`` tokens; a block lists its different n-grams, as 58-bit hashes in sorted, compressed arrays with its own counts, once, for counting and for asking alike.
Ranges of hashes add up the counts of all blocks and answer each block in the order of its list; then each block builds the part of the automaton
that its own texts can reach, and reads them. All texts of a block are read abreast, long ones in pieces (a piece begins in the state that the words before it lead to), so a traversal takes few steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, fold, mix, settle, small_batches, word_spans
from tidemark.llm.tries import distinct, packed, smallest, unpacked
from tidemark.scratch import forget

ORDER = 3
#: The strength of the prior in contexts of one word, of two and so on.
PRIOR = (40.0, 8.0, 4.0)
#: Tokens of a block, n-grams that meet in one range at most, and tokens of a piece. They divide work, not results.
BLOCK = 1_000_000
NODES = 2_500_000
PIECE = 512
#: Bits of an n-gram's key: its hash and two for its length. 58 bits of hash fit the disk, where 62 took 4.03 x input.
KEY_BITS = 60
#: Hashes of the two marks, the least of all; words have larger ones.
END, START = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(3)


class Grams:
    """The different n-grams of token sequences: for each length their keys, and for each token the n-gram that ends there (-1 where none does)."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, begins: np.ndarray, order: int):
        self.words, self.m = words, len(words)
        self.parents, self.labels, self.ends, self.keys = [], [], [], []
        n = len(tokens)
        place, can = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        inner = np.ones(n, dtype=bool)
        inner[begins] = False
        for k in range(order):
            if k:
                can = can[:-1] & inner[k:]
            at = np.flatnonzero(can)
            keys, own = distinct(place[at] * self.m + tokens[at + k])
            place = np.zeros(len(can), dtype=np.int64)
            place[at] = own
            end = np.full(n, -1, dtype=np.int64)
            end[at + k] = own
            self.parents.append(keys // self.m)
            self.labels.append(keys % self.m)
            self.ends.append(end)
            above = self.keys[-1][self.parents[k]] if k else np.uint64(0)
            self.keys.append(mix(above * _BASE + words[self.labels[k]] + np.uint64(k)) >> np.uint64(64 - KEY_BITS) & ~_LEVEL | np.uint64(k))  # the last two bits tell the length

    def all_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all lengths in rising order, and the place of each among them."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], place

    def counted(self, used: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at a token that is used, in the order of ``keys``."""
        return np.concatenate([np.bincount(e[used & (e >= 0)], minlength=len(k)) for e, k in zip(self.ends, self.keys, strict=True)])


class Automaton:
    """The states, arcs and failure arcs that the n-grams of a block can reach; state 0 is the empty context."""

    def __init__(self, grams: Grams, totals: np.ndarray, trained: int, distinct_words: int, prior: tuple[float, ...]):
        self.grams, self.m = grams, grams.m
        order = len(grams.keys)
        sizes = [len(k) for k in grams.keys]
        counts = np.split(totals, np.cumsum(sizes)[:-1])
        offsets = np.concatenate(([1], 1 + np.cumsum(sizes)))
        self.counts, links, seen = counts[0], [], []
        fail, loss = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
        arcs, weights, targets = [], [], []
        self.base = np.log10((counts[0] + 1) / (trained + distinct_words + 1))
        for k in range(order):
            parents, labels, own = grams.parents[k], grams.labels[k], counts[k]
            known = own > 0
            if k == 0:
                link, p = np.zeros(sizes[0], dtype=np.int64), (own + 1) / (trained + distinct_words + 1)
                arcs.append(labels)
                weights.append(self.base)
                targets.append(np.where(known, 1 + np.arange(sizes[0]), 0))
            else:
                shorter = grams.parents[k - 1] * self.m + grams.labels[k - 1]
                upper = links[-1][parents] if k > 1 else np.zeros(len(parents), dtype=np.int64)
                link = np.searchsorted(shorter, upper * self.m + labels)
                before = counts[k - 1][parents]
                p = np.zeros(len(own))
                p[known] = (own[known] + prior[k - 1] * seen[-1][link[known]]) / (before[known] + prior[k - 1])
                arcs.append(((offsets[k - 1] + parents) * self.m + labels)[known])
                weights.append(np.log10(p[known]))
                targets.append((offsets[k] + np.flatnonzero(known)) if k + 1 < order else offsets[k - 1] + link[known])
            links.append(link)
            seen.append(p)
            if k + 1 < order:
                fail.append(offsets[k - 1] + link if k else np.zeros(sizes[0], dtype=np.int64))
                loss.append(np.log10(prior[k] / (own + prior[k])))
        self.offsets, self.states = offsets, [c > 0 for c in counts[: order - 1]]
        self.arcs, self.weights, self.targets = np.concatenate(arcs), np.concatenate(weights), np.concatenate(targets)
        self.fail, self.loss = np.concatenate(fail), np.concatenate(loss)

    def after(self, at: np.ndarray) -> np.ndarray:
        """The state once these tokens have been read: the longest known context that ends there."""
        state = np.zeros(len(at), dtype=np.int64)
        for k, known in enumerate(self.states):
            node = self.grams.ends[k][at]
            there = node >= 0
            there[there] = known[node[there]]
            state[there] = self.offsets[k] + node[there]
        return state

    def read(self, tokens: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The weight of each piece of ``length`` tokens from ``begin`` on, read from the state that the tokens before it lead to."""
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, total = self.after(begin - 1), np.zeros(len(begin))
        last = len(self.arcs) - 1
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step, side="left"))  # those that are longer
            word, waiting = tokens[begin[:n] + step], np.arange(n)
            while len(waiting):
                key = state[waiting] * self.m + word[waiting]
                at = np.minimum(np.searchsorted(self.arcs, key), last)
                hit = self.arcs[at] == key
                went, at = waiting[hit], at[hit]
                total[went] += self.weights[at]
                state[went] = self.targets[at]
                waiting = waiting[~hit]
                total[waiting] += self.loss[state[waiting]]
                state[waiting] = self.fail[state[waiting]]
        out = np.empty(len(total))
        out[order] = total
        return out


def _blocks(size: int, order: int, kind: pa.DataType):
    """Texts gathered into blocks: their ids and lengths, the different words, the numbers of the tokens, and how many n-grams they have at most."""

    def made(counter: int, ids: list, held: list, hashes: list, lengths: list) -> pa.RecordBatch:
        words, tokens = distinct(np.concatenate([np.array([END, START], dtype=np.uint64), *hashes]))
        n = np.concatenate(lengths)
        ids, held = pa.concat_arrays(ids), np.concatenate(held)
        tokens = tokens[2:]
        block = TaskContext.get().partitionId() << 32 | counter
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([packed([words], [smallest(held.astype(np.int64)), smallest(n), smallest(tokens)])], pa.binary()),
                pa.array([int(n[~held].sum())], pa.int64()), pa.array([order * (len(tokens) + len(n))], pa.int64()),
            ],
            ["block", "ids", "data", "trained", "nodes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, n = 0, 0
        parts: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            hashes, row, _, _ = word_spans(*buffers(batch.column("text")))
            hashes[hashes <= START] += np.uint64(START)
            ends = np.searchsorted(row, np.arange(batch.num_rows), side="right")
            whole, upto = np.insert(hashes, ends, np.uint64(END)), ends + 1 + np.arange(batch.num_rows)
            ids, held = batch.column("id").cast(kind), batch.column("held_out").to_numpy(zero_copy_only=False)
            k = 0
            while k < batch.num_rows:
                done = int(upto[k - 1]) if k else 0
                stop = max(int(np.searchsorted(upto, done + size - n, side="right")), k if n else k + 1)  # as many as fit, and one at least
                if stop > k:
                    last = int(upto[stop - 1])
                    for some, new in zip(parts, (ids[k:stop], held[k:stop], whole[done:last], np.diff(upto[k:stop], prepend=done)), strict=True):
                        some.append(new)
                    n += last - done
                if n >= size or stop < batch.num_rows:
                    yield made(counter, *parts)
                    counter, n, parts = counter + 1, 0, ([], [], [], [])
                k = stop
        if n:
            yield made(counter, *parts)

    return run


def _grams(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> Grams:
    """N-grams of texts that follow each other, each read after a start mark."""
    begins = np.cumsum(lengths) - lengths
    return Grams(words, np.insert(tokens, begins, 1), begins + np.arange(len(begins)), order)


def _opened(data: bytes, order: int) -> tuple[np.ndarray, np.ndarray, Grams]:
    (words,), (held, lengths, tokens) = unpacked(data)
    return held.astype(bool), lengths, _grams(words, tokens, lengths, order)


def _asked(order: int, ranges: int):
    """A block's n-grams with its own counts, dealt by ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held, lengths, grams = _opened(data, order)
                keys, place = grams.all_keys()
                counts = np.empty(len(keys), dtype=np.int64)
                counts[place] = grams.counted(np.repeat(~held, lengths + 1))
                part = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)
                cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(cuts))
                for some in np.split(own, range(64, len(own), 64)):
                    blobs = [packed([keys[cuts[k] : cuts[k + 1]]], [smallest(counts[cuts[k] : cuts[k + 1]])]) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.repeat(block, len(some)), pa.array(blobs, pa.binary())], ["part", "block", "data"])

    return run


def _answered(key: tuple, held: pa.Table) -> pa.Table:
    """The sums of a range for each block, in the order of its list, and in a row without block the number of different words that were counted."""
    blobs = [unpacked(d) for d in held.column("data").to_pylist()]
    ends = np.cumsum([len(c[0]) for _, c in blobs])
    counts = np.concatenate([c[0] for _, c in blobs])
    whole = np.concatenate([k[0] for k, _ in blobs])
    del blobs
    keys, place = distinct(whole)
    del whole
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, place, counts)
    words = int(((keys & _LEVEL == 0) & (sums > 0)).sum())
    answers = [packed([], [smallest(sums[p])]) for p in np.split(place, ends[:-1])]
    n = len(answers)
    blocks = pa.concat_arrays([held.column("block").combine_chunks().cast(pa.int64()), pa.nulls(1, pa.int64())])
    return pa.table([blocks, pa.repeat(key[0], n + 1), pa.array([*answers, None], pa.binary()), pa.array([0] * n + [words], pa.int64())], ["block", "part", "data", "words"])


def _scored(order: int, trained: int, distinct_words: int, prior: tuple[float, ...], piece: int):
    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        held, lengths, grams = _opened(block.column("data")[0].as_py(), order)
        ids = block.column("ids").combine_chunks().flatten()
        parts = sorted(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True))
        _, place = grams.all_keys()
        totals = np.concatenate([unpacked(d)[1][0] for _, d in parts])[place]
        machine = Automaton(grams, totals, trained, distinct_words, prior)
        n = len(lengths)
        tokens = grams.labels[0][grams.ends[0]]
        first = np.cumsum(lengths + 1) - lengths  # where a text's own tokens begin, after its start mark
        pieces = -(-lengths // piece)
        of = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        weights = machine.read(tokens, first[of] + nth * piece, np.minimum(piece, lengths[of] - nth * piece))
        own = np.ones(len(tokens), dtype=bool)
        own[first - 1] = False
        word, text = grams.ends[0][own], np.repeat(np.arange(n), lengths)
        columns = [ids, pa.array(held), pa.array(lengths), pa.array(np.bincount(text, (machine.counts > 0)[word], n).astype(np.int64)), pa.array(np.bincount(text, machine.base[word], n)), pa.array(np.bincount(of, weights, n))]
        return pa.table(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def model_scores(docs: DataFrame, divisor: int = 7, held_out: int = 2, order: int = ORDER, prior: tuple[float, ...] = PRIOR, block: int = BLOCK, nodes: int = NODES, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``; the id has its own column's name.

    The model learns from the texts outside the held-out fold. A null text is an empty one, whose one token is its end. Rows with a null id are held out. Repeated rows count each and get
    the same scores, as equal texts do. Texts of any length are read whole. Where nothing is learned all tokens are unknown and all scores are 0. An empty table gives an empty table.
    Columns other than the two are not read, whatever their names. ``order`` is 2 to 4. N-grams are told apart by 58-bit hashes: among a
    thousand million of them about two share their counts with another.
    """
    if not 2 <= order <= 4:
        raise ValueError("the order is 2 to 4")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(fold(id_col, divisor) == held_out, F.lit(True)).alias("held_out"))
    id_type = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"block bigint, ids array<{id_type.simpleString()}>, data binary, trained bigint, nodes bigint"
    blocks = settle(rows.mapInArrow(_blocks(block, order, to_arrow_type(id_type)), schema), "blocks")
    sizes = blocks.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("trained"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes")).first()
    ranges = max(-(-sizes["nodes"] // nodes), spark.sparkContext.defaultParallelism)
    asked = blocks.select("block", "data").mapInArrow(_asked(order, ranges), "part int, block bigint, data binary")
    answers = settle(asked.groupBy("part").applyInArrow(_answered, "block bigint, part int, data binary, words bigint"), "answers")
    known = answers.where("block is null").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    words = known - (1 if sizes["trained"] else 0)  # the start mark is no token
    made = f"id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    pairs = blocks.select("block", "ids", "data").groupBy("block").cogroup(answers.where("block is not null").select("block", "part", "data").groupBy("block"))
    scored = settle(pairs.applyInArrow(_scored(order, sizes["trained"], words, prior, piece), made), "scored")
    for done in (blocks, answers):
        forget(done)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sizes["trained"]).cast("long").alias("train_tokens"), "base_score", "score")
