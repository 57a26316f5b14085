"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each task tokenises its documents. As many ids of a document as fill windows go out as full windows, which differencing would leave alone; the
remainders, whole, gather until they fill about ``GROUP_WINDOWS`` windows and are then divided into near-equal windows by largest
differencing: two partial partitions with the greatest spread are merged, the heavy slots of one on the light slots
of the other. If a window exceeds its capacity the number of windows rises by one and the group is divided again. Only the last part of a
group is cut fine, so that there is something to even the windows out with.

Nothing is shuffled and a task holds one batch and one group at a time. Every task pads at most its last group further.

A null text is empty: its document is the one end id. Empty tables give no pieces; repeated rows are packed each; a very long
text is cut into many windows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

WINDOW = 1024
END_ID = 0
GROUP_WINDOWS = 128
#: Remainders stay whole but in the last part TAIL of a group, where they are cut into pieces of at most FINE ids: differencing takes
#: the small ones last and evens the windows out with them. SLACK of a group's room stays free for what they leave uneven.
FINE, TAIL, SLACK = 64, 1 / 16, 0.004
TOKENIZER = "byte_bpe_50k.json"
#: The word pattern of this vocabulary. Possessive repeats match what the plain ones match, faster.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@functools.cache
def encoder(name: str = TOKENIZER):
    """A function from text to ids for a byte-level BPE vocabulary of the public tokenizers.

    The merges run in ``tiktoken``, which takes a fifth of the time that ``tokenizers`` takes for the same ids; the names of special
    tokens are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    coder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder.encode_ordinary


def balance(sizes: list[int], ways: int) -> list[list[int]]:
    """Divide the indices of ``sizes`` into ``ways`` parts with near-equal sums by multiway differencing.

    A partial partition is its sums, in falling order and less the smallest, with the indices of each slot. Only the slots that hold
    something are kept; the others are zero.
    """
    heap = [(-s, k, [s], [[k]]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, sums, slots = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        spare = ways - len(sums)
        if len(more) <= spare:  # the second goes to empty slots whole
            pairs = list(zip(sums + more, slots + others, strict=True))
        else:  # what has no empty slot left joins the lightest slots, heaviest on lightest
            joined = len(more) - spare
            pairs = list(zip(sums[: len(sums) - joined], slots[: len(sums) - joined], strict=True))
            pairs += [(more[k], others[k]) for k in range(spare)]
            for k in range(joined):
                low = len(sums) - 1 - k
                pairs.append((sums[low] + more[spare + k], slots[low] + others[spare + k]))
        pairs.sort(key=lambda p: -p[0])
        sums, slots = [p[0] for p in pairs], [p[1] for p in pairs]
        if len(sums) == ways and sums[-1]:
            least = sums[-1]
            sums = [s - least for s in sums]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == ways else 0)), serial, sums, slots))
        serial += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Near-equal parts of at most ``capacity``, as few as differencing finds."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = balance(sizes, ways)
        if all(sum(sizes[k] for k in part) <= capacity for part in parts):
            return parts
        ways += 1


def _pack(window: int, fine: int, group: int, name: str):
    goal = group * window - int(group * window * SLACK)
    late = goal - int(goal * TAIL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        waiting = 0
        out: list[tuple] = []

        def divide() -> None:
            nonlocal sequence
            for part in windows([p[2] for p in held], window):
                offset = 0
                for k in part:
                    out.append((*held[k], sequence, offset))
                    offset += held[k][2]
                sequence += 1
            held.clear()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                total = len(ids)
                whole = total - total % window
                for start in range(0, whole, window):
                    out.append((doc_id, start, window, ids[start : start + window].tobytes(), total, sequence, 0))
                    sequence += 1
                start = whole
                while start < total:
                    most = window if waiting < late else fine
                    stop = min(start + most, total, start + goal - waiting)
                    held.append((doc_id, start, stop - start, ids[start:stop].tobytes(), total))
                    waiting += stop - start
                    start = stop
                    if waiting == goal:
                        divide()
                        waiting = 0
            yield emit()
        if held:
            divide()
            yield emit()

    return pack


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    fine: int = FINE,
    group: int = GROUP_WINDOWS,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """One row for each piece: its document's id, where it starts there, its ids (little-endian unsigned 32 bits), its window and its offset in it."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_pack(window, fine, group, tokenizer), PIECES)
