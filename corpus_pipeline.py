"""A corpus pipeline: toxic and poor documents go, near duplicates collapse, sources are mixed to target weights, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the folder that the
cluster shares and reads it again for the next stage.

Rows are documents: rows that repeat an id are judged each by their own text. Extra columns pass through all stages but the last, and none of them is
read but ``doc_id``, ``text``, ``source`` and ``lang``. Very long texts count whole in every stage. Empty tables give empty tables with
the same columns. What nulls, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle, table
from tidemark.llm.mixing import mixed
from tidemark.llm.near_dedup import near_duplicates, with_own_ids
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality
from tidemark.llm.queries import piece_digests
from tidemark.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    A null text is judged as an empty one, equal texts alike, a null id like any. Where labels are too few to learn from, all rows stay.
    """
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null text is judged as an empty one, equal texts alike, a null id like any. Where labels are too few to learn from, all rows stay.
    """
    return quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1 or not learned").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows are told apart even where they share an id or have none (these have the largest ids here), so no text goes with another row of its id; of
    equal rows one stays. Texts without words are linked with nothing and all stay.
    """
    own = with_own_ids(docs)
    judged = near_duplicates(own.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")))
    return own.join(judged.where(~F.col("kept")).select(F.col("doc_id").alias("node")), "node", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics.

    A null source or language is a value of its own; texts without tokens carry no weight and are not sampled; equal rows share one decision.
    """
    return mixed(docs).where("sampled").select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their windows.

    A null text is an empty one, whose one piece is the end id; repeated rows and null ids are packed each.
    """
    return piece_digests(pack_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained classifiers, hashes and tokenizers are beyond SQL; the stages are tested against brute force and held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
