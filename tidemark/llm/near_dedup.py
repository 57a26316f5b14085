"""Near duplicates by banded MinHash, odd sketches and exact confirmation on whole shingle sets.

Every step works on tables: equal sets collapse into one representative, representatives that share a band meet,
an odd sketch (MinHash samples folded into a parity bitmap) discards pairs that are far from similar, and what is left is
confirmed on whole sets. A bucket first links its members to its smallest one; a leader of many members is dealt out in
copies, and its set is held once beside the stream of its members.

Where a bucket still holds several components, its members meet once more, by rare shingles: with all shingles in one order, those of a single
component first and then by frequency, two sets of that similarity share one of their first few. So texts that only have
boilerplate in common never meet, however many they are. The sketches of those that meet tell which components belong to one
family, and families are compared exactly, on whole sets, in blocks of bounded size; rows of a group's largest component meet the rest of
the group but not each other, so each is in as many blocks as the rest fills. Tasks emit spanning edges only, never all pairs of a group.

Nulls, ties and odd rows: a null or wordless text has an empty set, is linked with nothing and is kept. A row with a null
id is linked with nothing, has a null component and is kept. Rows that repeat an id are one node: all its texts link it. A very long text has a
long set and is treated like any other. Columns of the input other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, mix, settle, shingle_hashes, small_batches

#: At a similarity of 0.75 a pair shares no band with probability (1 - 0.75 ** 5) ** 40 = 2e-5.
BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: Sets are linked from this percentage of their union on.
PERCENT = 75
#: Members of a group, and shingles of a family, that make up one block; a task compares two blocks. Blocks divide work, not results.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Members that one copy of a leader is compared with.
RUN = 4096
#: Groups with more than one in HOT of all rows, fewer than HOT by count, are joined by broadcast.
HOT = 10_000
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def sketch_cut(percent: int = PERCENT, sigmas: float = 5.0) -> int:
    """The largest XOR population count of two sketches that may still belong to a pair of that similarity.

    The estimate of the similarity from k samples and n bits is 1 + n / 4k * ln(1 - 2z / n); its deviation, from the samples
    and the folding, is about 0.037 here. Five deviations below the threshold lose one pair in some millions.
    """
    k, n, j = BANDS * ROWS, SKETCH_BITS, percent / 100
    least = max(0.0, j - sigmas * ((j * (1 - j) / k) ** 0.5 + 0.006))
    return int(np.ceil(n / 2 * (1 - np.exp(-4 * k * (1 - least) / n))))


def minhash(members: np.ndarray) -> np.ndarray:
    """One minimum for each of the BANDS * ROWS hash functions."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    narrow = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(narrow), 2048):
        hashed = np.multiply.outer(_A, narrow[at : at + 2048])
        hashed += _B[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS))
    parts = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return keys.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, eight longs to a row: each sample flips one bit."""
    tagged = samples.astype(np.uint64) | (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32))
    bit = (mix(tagged) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bit += np.arange(len(samples))[:, None] * SKETCH_BITS
    flips = np.bincount(bit.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(samples), SKETCH_BITS), axis=1).view(np.int64)


def _lists(rows: np.ndarray, used: np.ndarray) -> pa.Array:
    """A list column with an empty list where ``used`` is false."""
    width = rows.shape[1]
    offsets = np.concatenate(([0], np.cumsum(np.where(used, width, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows[used].ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts = buffers(batch.column(1))
        sets = shingle_hashes(raw, starts)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        samples = np.stack([minhash(s) for s in sets]) if sets else np.zeros((0, BANDS * ROWS), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes),
                pa.array([xxhash.xxh128_digest(s) if len(s) else None for s in sets], pa.binary()),
                _lists(band_keys(samples), sizes > 0),
                _lists(odd_sketches(samples), sizes > 0),
            ],
            names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
        )


def _confirm(percent: int):
    """Rows (leader, run, id, text), sorted so that each run begins with its leader's own row, to pairs whose whole sets are as similar as asked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        after_head = False
        for batch in batches:
            leaders, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            linked = []
            for a, b, own in zip(leaders, ids, shingle_hashes(*buffers(batch.column(3))), strict=True):
                if a == b:
                    heads = [*heads, own] if after_head else [own]
                elif len(own):
                    shared = [len(np.intersect1d(h, own, assume_unique=True)) for h in heads]
                    if any(100 * n >= percent * (len(h) + len(own) - n) for n, h in zip(shared, heads, strict=True)):
                        linked.append((a, b))
                after_head = a == b
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in linked], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return confirm


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, component, text) to one row for each shingle."""
    for batch in batches:
        sets = shingle_hashes(*buffers(batch.column(2)))
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        names = np.array([xxhash.xxh64_intdigest(x) for x in sets], dtype=np.uint64).view(np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        for at in range(0, len(flat), 1 << 17):
            row = np.searchsorted(np.cumsum(sizes), np.arange(at, min(len(flat), at + (1 << 17))), side="right")
            columns = [*(batch.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(names[row]), pa.array(sizes[row]), pa.array(flat[at : at + (1 << 17)].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "comp", "own", "n", "shingle"])


def _far(a: str, b: str):
    """XOR population count of two sketch columns."""
    flips = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(flips, F.lit(0), lambda s, x: s + x)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one value in the first column."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != key:
                yield pa.concat_tables(held)
                held = []
            key = keys[a]
            held.append(rows.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


class _Forest:
    """Joins labels and keeps the edges that joined two trees."""

    def __init__(self, labels: np.ndarray) -> None:
        self.tree = labels.copy()
        self.edges: list[tuple[int, int]] = []

    def join(self, one: int, others: np.ndarray) -> None:
        """Join the row ``one`` with the rows ``others``."""
        for root in np.unique(self.tree[others]):
            own = self.tree[one]
            if root != own:
                low, high = min(own, root), max(own, root)
                self.edges.append((int(low), int(high)))
                self.tree[self.tree == high] = low

    def batch(self) -> pa.RecordBatch:
        a, b = zip(*self.edges, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _families(cut: int, percent: int):
    """Rows (block, component, size, first, sketch), sorted by block, to edges between components with near members.

    ``first`` tells whether the shingle they meet by is among the few of a smaller set. Rows of the most frequent component are not compared among themselves.
    """

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            comps = rows["comp"].to_numpy()
            values, counts = np.unique(comps, return_counts=True)
            if len(values) < 2:
                continue
            forest = _Forest(comps)
            n, first = rows["n"].to_numpy(), rows["first"].to_numpy()
            bits = rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64)
            for k in np.flatnonzero(comps != values[np.argmax(counts)]):
                small, large = np.minimum(n, n[k]), np.maximum(n, n[k])
                able = (100 * small >= percent * large) & np.where(n < n[k], first, np.where(n > n[k], first[k], first | first[k]))
                some = np.flatnonzero(able & (forest.tree != forest.tree[k]))
                if len(some):
                    near = np.bitwise_count(bits[some] ^ bits[k]).sum(axis=1, dtype=np.int64) <= cut
                    forest.join(int(k), some[near])
            if forest.edges:
                yield forest.batch()

    return families


def _compare(percent: int):
    """Rows (block, component, text), sorted by block, to edges between components with similar members.

    The shared shingles of one row with all rows of the block are counted at once, over the block's list of shingles. Rows of the most
    frequent component need no comparison among themselves.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            comps = rows["comp"].to_numpy()
            values, counts = np.unique(comps, return_counts=True)
            if len(values) < 2:
                continue
            sets = shingle_hashes(*buffers(rows["text"]))
            sizes = np.array([len(s) for s in sets])
            shingles, places = np.unique(np.concatenate(sets), return_inverse=True)
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            forest = _Forest(comps)
            mark = np.zeros(len(shingles), dtype=np.int32)
            for k in np.flatnonzero(comps != values[np.argmax(counts)]):
                own = places[begin[k] : begin[k] + sizes[k]]
                mark[own] = 1
                shared = np.add.reduceat(mark[places], begin)
                mark[own] = 0
                forest.join(int(k), np.flatnonzero(100 * shared >= percent * (sizes + sizes[k] - shared)))
            if forest.edges:
                yield forest.batch()

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that can be reached.

    Each round hooks every live label to the smallest label next to it and contracts the edges; a star takes one round and
    a chain about as many rounds as the logarithm of its length. Minima are combined before they are shuffled.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    live = settle(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        hook = settle(live.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        if labels is None:
            labels = hook.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            moved = hook.select(F.col("a").alias("component"), "to")
            labels = settle(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        left = hook.select("a", F.col("to").alias("x"))
        right = hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        live = settle(live.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return labels if labels is not None else live.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _in_blocks(rows: DataFrame, key: str, minor: Column, major: Column) -> DataFrame:
    """Rows with a column ``block``: each pair of ids under one key meets in a block, but for pairs of the key's largest component.

    ``minor`` and ``major`` are the numbers of parts that the other rows and those of the largest component (``main``) are dealt into.
    """
    s, m = minor.cast("int"), major.cast("int")
    rows = rows.withColumns({"_s": s, "_m": m, "_minor": F.col("comp") != F.col("main")})
    own = F.when(F.col("_minor"), F.pmod(F.xxhash64("id"), "_s")).otherwise(F.col("_s") + F.pmod(F.xxhash64("id"), "_m")).cast("int")
    last = F.when(F.col("_minor"), F.col("_s") + F.col("_m")).otherwise(F.col("_s")) - 1
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("block", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_s", "_m", "_minor", "_own", "_other")


def _parted(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, main, held, minor, major) for keys with several components: the largest component, its weight and that of the others, and all rows."""
    each = rows.groupBy(key, "comp").agg(F.sum(weight).alias("w"), F.count("*").alias("c"))
    whole = each.groupBy(key).agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("all"), F.sum("c").alias("held"), F.count("*").alias("comps")).where("comps > 1")
    return whole.select(key, F.col("top.comp").alias("main"), "held", (F.col("all") - F.col("top.w")).alias("minor"), F.col("top.w").alias("major"))


def _met(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``groups``, one row for each key that counts its rows as ``size``.

    Fewer than HOT groups hold more than one in HOT of the rows, so these are broadcast and their rows stay where they are; no task gets a
    large group by shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.where(F.col(size) * HOT > total)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(large), key).unionByName(rest)


def with_own_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(node, row): each row whole, whatever its columns are named, with a long that no two rows share: the id, or a number above all ids where it is not the row's alone, or null (these come last)."""
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    known = rows.where("node is not null")
    repeated = settle(known.groupBy("node").count().where("count > 1").select("node"), "repeated")
    top = rows.agg(F.max("node")).first()[0] or 0
    more = known.join(repeated, "node", "left_semi").unionByName(rows.where("node is null"))
    numbered = settle(more.select((F.monotonically_increasing_id() + F.lit(top + 1)).alias("node"), "row"), "numbered")
    return known.join(repeated, "node", "left_anti").select("node", "row").unionByName(numbered)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = settle(texts.mapInArrow(_sign, SIGNATURE), "signatures")

    # Equal sets: one representative, its smallest id.
    best = F.min(F.struct("doc_id", "n_shingles", "bands", "sketch"))
    classes = settle(
        signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(best.alias("r"), F.count("*").alias("copies")).select("set_key", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.bands", "r.sketch", "copies"),
        "classes",
    )
    banded = classes.select("id", F.explode("bands").alias("key"))
    leaders = settle(banded.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("m")).where("m > 1"), "leaders")
    members = settle(_met(banded, leaders, "key", "m"), "members")
    involved = members.select("id").distinct()
    sketches = settle(classes.select("id", "n_shingles", "sketch").join(involved, "id", "left_semi"), "sketches")
    sources = settle(texts.join(involved.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").where("text is not null"), "sources")
    cut = sketch_cut(percent)

    # Each member with the smallest member of its bucket. A leader's text goes once to every run of its members.
    stars = members.where("id <> leader").select("leader", "id").distinct()
    met = settle(stars.groupBy("leader").agg(F.count("*").alias("held")), "met")
    ahead = met.join(sketches.select(F.col("id").alias("leader"), F.col("sketch").alias("u")), "leader")
    near = _met(stars, settle(ahead, "ahead"), "leader", "held").join(sketches.select("id", F.col("sketch").alias("v")), "id")
    near = settle(near.where(_far("u", "v") <= cut).select("leader", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / RUN)).cast("int").alias("run")), "near")
    beside = near.join(sources.select(F.col("doc_id").alias("id"), "text"), "id").select("leader", "run", "id", "text")
    heads = near.select("leader", "run").distinct().join(sources.select(F.col("doc_id").alias("leader"), "text"), "leader")
    beside = beside.unionByName(heads.select("leader", "run", F.col("leader").alias("id"), "text"))
    ordered = beside.repartition("leader", "run").sortWithinPartitions("leader", "run", F.col("id") != F.col("leader"))
    found = components(ordered.mapInArrow(_confirm(percent), "a long, b long"))

    # What still shares a bucket across components meets by rare shingles.
    labelled = sketches.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "sketch")
    labelled = settle(labelled, "labelled")
    apart = members.where("m > 2").select("key", "id", "m").join(labelled.select("id", "comp"), "id")
    mixed = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).where("lo < hi")
    unsettled = settle(_met(apart.select("key", "id", "comp"), settle(mixed.select("key", "held"), "mixed"), "key", "held").select("id", "comp").distinct(), "unsettled")
    texts = unsettled.join(sources.select(F.col("doc_id").alias("id"), "text"), "id").select("id", "comp", "text")
    single = settle(texts.mapInArrow(_shingled, "id long, comp long, own long, n long, shingle long"), "shingles")
    shared = single.groupBy("shingle").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle", "df")
    listed = _met(single, settle(shared, "shared"), "shingle", "df").groupBy("id", "comp", "own", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("by"))
    # Of n shingles, as many of the first ones decide as may be missing; those of one component alone (n less the list's size) come before the list.
    alone = F.col("n") - F.size("by")
    wide = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    narrow = F.col("n") - F.ceil(2 * F.col("n") * percent / (100 + percent)) + 1 - alone
    rare = listed.where(wide > 0).select("id", "comp", "n", narrow.alias("narrow"), F.posexplode(F.slice("by", F.lit(1), wide.cast("int"))).alias("at", "s"))
    rare = settle(rare.select(F.col("s.shingle").alias("shingle"), "id", "comp", "n", (F.col("at") < F.col("narrow")).alias("first")), "rare")
    groups = settle(_parted(rare, "shingle", F.lit(1)), "groups")
    blocks = _in_blocks(_met(rare, groups, "shingle", "held"), "shingle", F.ceil(F.col("minor") / BLOCK), F.ceil(F.col("major") / BLOCK))
    blocks = blocks.select("block", "id", "comp", "n", "first").join(labelled.select("id", "sketch"), "id").select("block", "comp", "n", "first", "sketch")
    family = components(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_families(cut, percent), "a long, b long"))

    # Members of a family on whole sets, blocks of about BLOCK_SHINGLES against each other.
    sizes = single.groupBy("id", "comp").agg(F.count("*").alias("n"))
    kin = settle(sizes.join(family.select(F.col("id").alias("comp"), F.col("component").alias("family")), "comp"), "kin")
    parted = settle(_parted(kin, "family", F.col("n")), "families")
    kin = _in_blocks(_met(kin, parted, "family", "held"), "family", F.ceil(F.col("minor") / BLOCK_SHINGLES), F.ceil(F.col("major") / BLOCK_SHINGLES)).select("block", "id", "comp")
    kin = kin.join(sources.select(F.col("doc_id").alias("id"), "text"), "id").select("block", "comp", "text")
    late = kin.repartition("block").sortWithinPartitions("block").mapInArrow(_compare(percent), "a long, b long")
    moved = components(late).select(F.col("id").alias("component"), F.col("component").alias("final"))

    ends = classes.select("set_key", "id", "copies").join(found, "id", "left").select("set_key", "copies", F.coalesce("component", "id").alias("component"))
    ends = ends.join(moved, "component", "left").select("set_key", "copies", F.coalesce("final", "component").alias("component_id"))
    signed = signed.select("doc_id", "n_shingles", "set_key")
    grouped = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    joined = _met(signed.where(grouped), settle(ends, "ends"), "set_key", "copies").select("doc_id", "n_shingles", "component_id")
    joined = joined.unionByName(signed.where(~grouped).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
