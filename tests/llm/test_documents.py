"""Operators on whole documents against brute force, round trips and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import near_dedup
from tidemark.llm.common import buffers, shingle_hashes, table, word_hashes
from tidemark.llm.fingerprints import OTHERS, differing_sections, fingerprint, fingerprints, likeness, pieces, spliced, tree
from tidemark.llm.near_dedup import components, near_duplicates
from tidemark.llm.packing import WINDOW, balance, encoder, pack_documents, windows
from tidemark.llm.queries import piece_digests
from tidemark.llm.sharding import _sides, permuted, sharded
from tidemark.llm.transport_stream import BLOCK, demux, mux, padded, stream_digests

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


# ---------------------------------------------------------------------------------------------- words and near duplicates
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x1c  éß漢.", max_size=60)), max_size=8))
@examples(max_examples=60, deadline=None)
def test_shingle_sets(texts):
    raw, starts = buffers(pa.array(texts, pa.string()))
    hashes, row = word_hashes(raw, starts)
    assert Counter(row.tolist()) == Counter({k: len(words(t)) for k, t in enumerate(texts) if words(t)})
    want = [words(t) for t in texts]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    assert [len(s) for s in shingle_hashes(raw, starts)] == [len(shingles(t)) for t in texts]


def brute_components(rows):
    """(set size, smallest id that can be reached) of each id."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        met = Counter(j for g in sets[i] for j in holders[g])
        for g in sets[i]:
            holders[g].append(i)
        for j, n in met.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == docs.count()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_family_around_the_threshold(spark, monkeypatch):
    """Hundreds of edits of one text, many pairs just above or below the threshold, over several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(near_dedup, "HOT", 4)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}
    assert len(set(got.values())) > 1


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs).collect()}
    assert {(1, 7, 1, True), (5, 7, 1, False), (2, 0, 2, True), (3, 0, 3, True), (8, 0, 8, True), (9, 1, 9, True), (None, 1, None, True)} <= got
    assert {(r.component_id) for r in near_duplicates(odd_docs.where("doc_id in (4, 11)")).collect()} == {4}
    assert near_duplicates(odd_docs).count() == odd_docs.count()
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (55, 200), (200, 60)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, 55: 55, 60: 55, 200: 55}


# ---------------------------------------------------------------------------------------------- packing
def brute_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def check_pieces(docs, pieces):
    encode = brute_ids(None)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[(r.doc_id, tuple(encode(r.text)))] += 1
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc[(p.doc_id, p.doc_tokens)].append((p.start, ids))
        by_window[p.sequence_id].append((p.offset, p.length))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= WINDOW
    return want, by_doc, by_window


def test_every_id_is_in_one_piece(spark):
    docs = table(spark, SF, "documents")
    want, by_doc, by_window = check_pieces(docs, pack_documents(docs).collect())
    got = Counter()
    for (doc, total), parts in by_doc.items():
        parts.sort()
        ids = [x for _, part in parts for x in part]
        assert [s for s, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist() and len(ids) == total
        got[(doc, tuple(ids))] += 1
    assert got == want
    total = sum(n for parts in by_window.values() for _, n in parts)
    assert total / (WINDOW * len(by_window)) > 0.95


def test_pieces_of_odd_rows(odd_docs, no_docs):
    want, by_doc, _ = check_pieces(odd_docs, pack_documents(odd_docs).collect())
    assert sum(len(ids) for _, ids in want.elements()) == sum(len(p) for parts in by_doc.values() for _, p in parts)
    assert sum(n for parts in by_doc.values() for n in [len(parts)]) == piece_digests(pack_documents(odd_docs)).count()
    assert pack_documents(no_docs).count() == 0


@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 12))
@examples(max_examples=80, deadline=None)
def test_differencing(sizes, ways):
    parts = balance(sizes, ways)
    assert sorted(k for p in parts for k in p) == list(range(len(sizes))) and len(parts) <= ways
    if len(sizes) >= ways > 0:
        sums = [sum(sizes[k] for k in p) for p in parts] + [0] * (ways - len(parts))
        assert max(sums) - min(sums) <= max(sizes)
    assert all(sum(sizes[k] for k in p) <= 1024 for p in windows(sizes))


def test_encoder_equals_the_tokenizers_library():
    encode, own = brute_ids(None), encoder()
    for text in ("", "  a  b\n\n\nc ", "don't we'll I'VE", "x²³ ½ 漢字 ١٢ 🎉", "<|endoftext|> tail", "\t\x00\r\n ", "ÀÉ\u00a0\u2003z" * 3):
        assert [*own(text), 0] == encode(text)


# ---------------------------------------------------------------------------------------------- sharding
def test_few_numbers_leave_the_range():
    for n in (7, 10007, 10**9 + 7, 10**11 + 3):
        a, b = _sides(n)
        assert n <= a * b < n + math.isqrt(n) and a < 2 * b + 8 and a * b - n < max(2, 10 * math.isqrt(n) // 512 + 8)


def test_permutation(spark):
    for n in (1, 2, 3, 7, 10, 99, 1000, 1024, 10007, 4095):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 3)).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(spark, odd_docs, shards):
    for docs in (table(spark, SF, "documents"), odd_docs.union(odd_docs.where("doc_id = 6"))):
        got = sharded(docs, shards).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 0, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r.size - 16, r.text_crc32) for r in got) == want
        assert sorted(r.row_number for r in got) == list(range(len(got)))
        counts = Counter(r.shard for r in got)
        sizes = [counts[k] for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        for k in range(shards):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))


def test_shards_repeat_and_empty(spark, odd_docs, no_docs):
    key = lambda r: (r.doc_id or -1, r.size, r.row_number, r.shard, r.slot)
    assert sorted(map(key, sharded(odd_docs).collect())) == sorted(map(key, sharded(odd_docs.repartition(5)).collect()))
    assert sharded(no_docs).count() == 0


# ---------------------------------------------------------------------------------------------- media and fingerprints
@given(st.one_of(st.none(), st.text(max_size=400), st.integers(0, 9000).map(lambda n: "ab" * n)))
@examples(max_examples=60, deadline=None)
def test_transport_stream_round_trip(text):
    payload = padded(text)
    assert len(payload) % BLOCK == 0 and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ")
    stream = mux(payload)
    read = demux(stream)
    assert len(stream) % 188 == 0 and all(stream[k] == 0x47 for k in range(0, len(stream), 188))
    assert read["payload"] == payload and not read["continuity_gaps"] and not read["crc_errors"]
    assert read["random_access"] == read["timestamps"][::8] and read["packets"] == len(stream) // 188


def test_transport_stream_errors():
    stream = mux(padded("x" * 20000))
    assert demux(stream[: 188 * 5] + stream[188 * 6 :])["continuity_gaps"] == 1
    assert demux(stream[: 188 * 5] + stream[188 * 4 :])["payload"] == padded("x" * 20000)  # a packet sent twice
    broken = bytearray(stream)
    broken[20] ^= 1
    assert demux(bytes(broken))["crc_errors"] == 1
    assert demux(b"")["payload"] == b""


def test_stream_digests(odd_docs, no_docs):
    rows = {(r.doc_id, r.n_bytes): r for r in stream_digests(odd_docs).collect()}
    for r in odd_docs.collect():
        payload = padded(r.text)
        got = rows[(r.doc_id, len((r.text or "").encode()))]
        assert got.payload_sha256 == hashlib.sha256(payload).hexdigest() and got.tail_crc32 == zlib.crc32(payload[-16:]) and got.payload_bytes == len(payload)
        assert got.media_sha256 == hashlib.sha256(mux(payload)).hexdigest() and got.media_bytes == len(mux(payload))
    assert stream_digests(no_docs).count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_fingerprints_of_successors(spark, partitions):
    docs = table(spark, SF, "documents").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.fingerprint == fingerprint(t) and r.edited_fingerprint == fingerprint(edited)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == likeness(fingerprint(t), fingerprint(edited)) and r.near_next == likeness(fingerprint(t), fingerprint(following))


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    got = fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count() and fingerprints(no_docs).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprints(odd_docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.n_chars == 55


def test_fingerprint_finds_edits():
    text = "\n".join(f"Paragraph {k} says this. And that {k * k}." for k in range(60))
    edited = text.replace("Paragraph 30 says", "Paragraph 30 denies")
    assert fingerprint(text) == fingerprint(str(text)) and fingerprint(text) != fingerprint(edited)
    assert 0.95 < likeness(fingerprint(text), fingerprint(edited)) < 1
    assert len(differing_sections(fingerprint(text), fingerprint(edited))) <= 2
    assert likeness(fingerprint(""), fingerprint(None)) == 1.0 and likeness(fingerprint("a"), fingerprint("")) == 0.0
    assert spliced("abcde", "xyz") == "abcxy" and spliced("abcdef", "x") == "abcx"


def test_likeness_heeds_order_and_finds_words():
    lines = [f"line {k} has {k * k} words" for k in range(80)]
    turned = "\n".join(lines[40:] + lines[:40])
    assert 0.4 < likeness(fingerprint("\n".join(lines)), fingerprint(turned)) < 0.6
    assert likeness(fingerprint("\n".join(lines)), fingerprint("\n".join(lines[::-1]))) < 0.2
    han = "".join(chr(0x4E00 + k * k % 20000) for k in range(2000))
    for text in (han, " ".join(f"word{k * k}" for k in range(2000)), "".join(f"这是第{k * k}个句子。" for k in range(200))):
        assert likeness(fingerprint(text), fingerprint(text[:700] + "改" + text[701:])) > 0.9


def test_fingerprints_are_bounded():
    text = " ".join(f"w{k * 7919 % 100003}" for k in range(200_000))
    edited = text[: len(text) // 2] + "something else" + text[len(text) // 2 + 14 :]
    mark = fingerprint(text)
    assert len(mark) < 12_000 and 0.98 < likeness(mark, fingerprint(edited)) < 1
    assert 0.4 < likeness(mark, fingerprint(text[: len(text) // 2] + "q " * (len(text) // 4))) < 0.6
    assert likeness(mark, fingerprint("short")) == 0


@pytest.mark.parametrize(
    "text",
    [
        "Orre " * 3000, "#$%&*!|" * 500, "x" * 5000, "| 12 | ab | 7.5 " * 200, " ".join(f"word{k * k}" for k in range(2000)), "! ".join(f"Cry {k * 7} of it" for k in range(300)),
        "".join(chr(0x4E00 + k * k % 20000) for k in range(3000)), "a short line of a few dozen characters, no mark at all",
    ],
)
def test_one_line_texts_have_bounded_leaves(text):
    assert "".join(pieces(text)) == text and max(map(len, pieces(text))) <= OTHERS[1]
    edited = spliced(text, "Quite another text 123, that goes on and on. " * 400)
    share = likeness(fingerprint(text), fingerprint(edited))
    assert share > 0 and (len(text) < 1000 or 0.3 < share < 0.8)


def test_edits_within_one_line_are_found():
    text = " ".join(f"word{k * k}" for k in range(4000))
    edited = text.replace(" word4000000 ", " another thing ")
    assert likeness(fingerprint(text), fingerprint(edited)) > 0.97
    assert len(tree(text)) > 5 and 1 <= len(differing_sections(fingerprint(text), fingerprint(edited))) <= 2
    assert max(len(s) for s in tree("Orre " * 90_000)) <= 32
