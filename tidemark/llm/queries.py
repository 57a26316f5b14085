"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.collocations import collocations
from tidemark.llm.common import table
from tidemark.llm.fingerprints import fingerprints
from tidemark.llm.language_model import model_scores
from tidemark.llm.mixing import mixed
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.preferences import format_preferences, swapped_pairs
from tidemark.llm.quality import quality
from tidemark.llm.sharding import sharded
from tidemark.llm.toxicity import toxicity
from tidemark.llm.transport_stream import stream_digests
from tidemark.llm.url_filter import Rule, judge
from tidemark.llm.vector_codes import vector_codes

URL_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_digests(table(spark, sf_dir, "documents"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(table(spark, sf_dir, "documents")))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(swapped_pairs(table(spark, sf_dir, "conversations")))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ";") for c in ("chosen_spans", "rejected_spans")}
    return made.select(F.col("id").alias("conv_id"), "prefix_turns", "prompt", "chosen", spans["chosen_spans"].alias("chosen_spans"), "rejected", spans["rejected_spans"].alias("rejected_spans"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "held_out", "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed(table(spark, sf_dir, "documents"))
    return made.select("row.doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled", "met")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "held_out", "score", "predicted")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = model_scores(table(spark, sf_dir, "documents"))
    return made.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # the digits beyond depend on the order of the sum


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_media_columns, op3_packing, op4_preference_format, op5_sharding, op6_toxicity, op7_mixing, op8_fingerprints, op9_near_dedup, op10_quality,
        op11_language_model, op12_collocations, op13_vector_codes,
    )
}

_OP1 = """
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM rest
), rules(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged AS (
  SELECT page_id, host, path, rh || rp AS rule, rv AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM split LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE k = 1
"""

_RENDER = "list_transform({0}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10))"
_TEXT = "array_to_string(" + _RENDER + ", '')"
_SPANS = (
    "array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda k: {0}[k].role = 'assistant'), lambda k: "
    "(length(array_to_string(" + _RENDER.format("{0}[1:k - 1]") + ", '')) + 14)::VARCHAR || '-' || length(array_to_string(" + _RENDER.format("{0}[1:k]") + ", ''))::VARCHAR), ';')"
)
_OP4 = f"""
WITH whole AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id
), ends AS (
  SELECT conv_id, turns, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda k: turns[k].role = 'assistant')), 0) AS last FROM whole
), said AS (
  SELECT conv_id, last, CASE WHEN last > 0 THEN turns[1:last] ELSE turns END AS chosen, CASE WHEN last > 0 THEN turns[last].text END AS reply FROM ends
), pairs AS (
  SELECT a.conv_id, a.chosen,
         CASE WHEN a.last > 0 AND b.reply IS NOT NULL THEN list_append(a.chosen[1:a.last - 1], {{'role': a.chosen[a.last].role, 'text': b.reply}}) END AS rejected
  FROM said a LEFT JOIN said b ON b.conv_id = xor(a.conv_id, 1)
), cut AS (
  SELECT *, CASE WHEN rejected IS NULL THEN len(chosen) - 1
                 ELSE coalesce(list_min(list_filter(range(1, len(chosen) + 1), lambda k: chosen[k] IS DISTINCT FROM rejected[k])) - 1, len(chosen)) END AS p FROM pairs
), parts AS (
  SELECT conv_id, p, chosen[1:p] AS prefix, chosen[p + 1:] AS won, CASE WHEN rejected IS NOT NULL THEN rejected[p + 1:] END AS lost FROM cut
)
SELECT conv_id, p::INTEGER AS prefix_turns, {_TEXT.format("prefix")} AS prompt, {_TEXT.format("won")} AS chosen, {_SPANS.format("won")} AS chosen_spans,
       CASE WHEN lost IS NOT NULL THEN {_TEXT.format("lost")} END AS rejected, CASE WHEN lost IS NOT NULL THEN {_SPANS.format("lost")} END AS rejected_spans
FROM parts
"""

_OP9 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM split
), sized AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM sets
), each AS (SELECT doc_id, n, unnest(g) AS s FROM sized
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, c) AS (SELECT DISTINCT x, x FROM ways UNION SELECT ways.y, reach.c FROM reach JOIN ways ON ways.x = reach.doc_id
), least_of AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sized LEFT JOIN least_of USING (doc_id)
"""

_CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)

_OP11 = r"""
WITH seqs AS (
  SELECT row_number() OVER () AS rid, doc_id, text, list_concat(['<s>' || chr(9)], list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)])) AS w,
         coalesce(@ % 7 = 2, true) AS held_out FROM documents
), places AS (SELECT rid, held_out, w, unnest(range(2, len(w) + 1)) AS i FROM seqs
), read AS MATERIALIZED (SELECT rid, held_out, i, w[i] AS a, w[i - 1] AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM places
), learned AS (SELECT * FROM read WHERE NOT held_out
), n1 AS MATERIALIZED (SELECT a, count(*) AS n FROM learned GROUP BY a
), n2 AS MATERIALIZED (SELECT b, a, count(*) AS n FROM learned GROUP BY b, a
), n3 AS MATERIALIZED (SELECT c, b, a, count(*) AS n FROM learned WHERE c IS NOT NULL GROUP BY c, b, a
), h1 AS MATERIALIZED (SELECT b, sum(n) AS n FROM n2 GROUP BY b
), h2 AS MATERIALIZED (SELECT c, b, sum(n) AS n FROM n3 GROUP BY c, b
), all_of AS (SELECT coalesce(sum(n), 0)::BIGINT AS tokens, count(*) AS words FROM n1
), found AS (
  SELECT rid, i, coalesce(n1.n, 0) AS x1, coalesce(n2.n, 0) AS x2, coalesce(n3.n, 0) AS x3, coalesce(h1.n, 0) AS y1, coalesce(h2.n, 0) AS y2
  FROM read r LEFT JOIN n1 ON n1.a = r.a LEFT JOIN n2 ON n2.b = r.b AND n2.a = r.a LEFT JOIN n3 ON n3.c = r.c AND n3.b = r.b AND n3.a = r.a LEFT JOIN h1 ON h1.b = r.b LEFT JOIN h2 ON h2.c = r.c AND h2.b = r.b
), shares AS (SELECT rid, i, x1, x2, x3, y1, y2, (x1 + 1)::DOUBLE / (tokens + words + 1) AS p1 FROM found, all_of
), twos AS (SELECT *, CASE WHEN y1 > 0 THEN (x2 + 40.0::DOUBLE * p1) / (y1 + 40.0::DOUBLE) ELSE p1 END AS p2 FROM shares
), threes AS (SELECT *, CASE WHEN y2 > 0 THEN (x3 + 8.0::DOUBLE * p2) / (y2 + 8.0::DOUBLE) ELSE p2 END AS p3 FROM twos
), sums AS (
  SELECT rid, count(*) AS n_tokens, count(*) FILTER (x1 > 0) AS n_known, list_sum(list(log10(p1) ORDER BY i)) AS base, list_sum(list(log10(p3) ORDER BY i)) AS score FROM threes GROUP BY rid
)
SELECT doc_id, held_out, n_tokens, n_known, tokens AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM seqs JOIN sums USING (rid), all_of
""".replace("@", _CRC32.format("doc_id"))

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM split, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g
), c AS MATERIALIZED (SELECT lang, k, g, a, string_split(g, ' ') AS p FROM f WHERE k > 1 AND a >= 10
), halves AS (SELECT *, array_to_string(p[1:j], ' ') AS lg, array_to_string(p[j + 1:], ' ') AS rg FROM c, (VALUES (1), (2)) t(j) WHERE j < k
), cuts AS (
  SELECT h.lang, h.k, h.g, h.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * h.a * h.a) // (l.a::HUGEINT * r.a) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.k = j AND l.g = lg JOIN f r ON r.lang = h.lang AND r.k = h.k - j AND r.g = rg
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), longer AS (
  SELECT lang, g, max(a) AS around FROM (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS g, a FROM c WHERE k = 3) GROUP BY lang, g
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON k = 2 AND longer.lang = lowest.lang AND longer.g = lowest.g WHERE around IS NULL OR 100::HUGEINT * around < 50::HUGEINT * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept
), sizes AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def _lloyd(rounds: int = 6) -> str:
    """The rounds one after the other, each part compared with all entries of its codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT rid, x.p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN c{k} USING (p)
  ) GROUP BY rid, p
)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
  SELECT p, e, place, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS m FROM (
    SELECT p, best.e AS e, place, sum(v[place]) AS s, count(*) AS n FROM a{k} JOIN parts USING (rid, p), range(1, 1 + (SELECT max(len(v)) FROM parts)) t(place) GROUP BY p, best.e, place
  )
), m{k} AS (SELECT p, e, list(m::BIGINT ORDER BY place) AS c FROM s{k} GROUP BY p, e
), c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return ", ".join(steps)


_OP13 = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, p, ints[p * len(ints) // 8 + 1:(p + 1) * len(ints) // 8] AS v FROM kept, range(8) t(p)
), c0 AS (SELECT p, rid - 1 AS e, v AS c FROM parts WHERE rid <= 16
), {_lloyd()}, books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6
), coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a6 GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books
"""

#: DuckDB SQL where it can express a query.
ORACLES: dict[str, str] = {"op1_url_filter": _OP1, "op4_preference_format": _OP4, "op9_near_dedup": _OP9, "op11_language_model": _OP11, "op12_collocations": _OP12, "op13_vector_codes": _OP13}
