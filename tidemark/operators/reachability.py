"""Which commits can be reached from which, as jobs over a table of parents.

Histories are long and narrow, so a search that goes from parents to parents would take as many rounds as the longest line. Here commits first form chains along first parents: a commit hands its chain on to
one of the children that have it as first parent. Places in chains come from pointer jumping, in as many joins as the logarithm of the longest chain. What is reached of a chain is all of it from
a place on, so the search goes over chains and only keeps that place for each: it takes as many rounds as branches nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import forget, kept


def parent_edges(graph: DataFrame) -> DataFrame:
    """(repo_id, hash, nth, parent) of a table (repo_id, hash, parents); parents that the table doesn't have lead nowhere."""
    return graph.select("repo_id", "hash", F.posexplode("parents").alias("nth", "parent"))


def chains(graph: DataFrame) -> DataFrame:
    """(repo_id, hash, chain, place): each commit's chain, named by its newest commit, and how many commits of it are newer."""
    heir = parent_edges(graph).where("nth = 0").groupBy("repo_id", F.col("parent").alias("hash")).agg(F.min("hash").alias("child"))
    now = graph.select("repo_id", "hash").distinct().join(heir, ["repo_id", "hash"], "left")
    now = kept(now.select("repo_id", "hash", F.coalesce("child", "hash").alias("chain"), F.col("child").isNotNull().cast("long").alias("place")), "chains")
    while True:
        ahead = now.select("repo_id", F.col("hash").alias("chain"), F.col("chain").alias("further"), F.col("place").alias("more"))
        jumped = now.join(ahead, ["repo_id", "chain"]).select("repo_id", "hash", F.col("further").alias("chain"), (F.col("place") + F.col("more")).alias("place"), "more")
        jumped = kept(jumped, "chains")
        forget(now)
        moved = not jumped.where("more > 0").isEmpty()
        now = jumped.drop("more")
        now.kept_in = jumped.kept_in
        if not moved:
            return now


def reachable(graph: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo_id, hash) of the commits that the tips (repo_id, hash) are or descend from."""
    placed = chains(graph)
    own = placed.select("repo_id", F.col("hash").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    ways = parent_edges(graph).join(placed, ["repo_id", "hash"]).join(own, ["repo_id", "parent"])
    ways = ways.where((F.col("chain") != F.col("to_chain")) | (F.col("to_place") != F.col("place") + 1)).select("repo_id", "chain", "place", "to_chain", "to_place")
    ways = kept(ways, "ways")
    first = tips.join(placed, ["repo_id", "hash"]).groupBy("repo_id", "chain").agg(F.min("place").alias("since"))
    front = kept(first.withColumn("until", F.lit(None).cast("long")), "front")  # what is new of a chain: from one place up to another, or to its end
    reached = front.select("repo_id", "chain", "since")
    while not front.isEmpty():
        met = ways.join(front, ["repo_id", "chain"]).where((F.col("place") >= F.col("since")) & (F.col("until").isNull() | (F.col("place") < F.col("until"))))
        met = met.groupBy("repo_id", F.col("to_chain").alias("chain")).agg(F.min("to_place").alias("since"))
        old = reached.groupBy("repo_id", "chain").agg(F.min("since").alias("until"))
        front = kept(met.join(old, ["repo_id", "chain"], "left").where("until is null or since < until").select("repo_id", "chain", "since", "until"), "front")
        reached = reached.union(front.select("repo_id", "chain", "since"))
    whole = reached.groupBy("repo_id", "chain").agg(F.min("since").alias("since"))
    return placed.join(whole, ["repo_id", "chain"]).where("place >= since").select("repo_id", "hash")


def trusted(graph: DataFrame, refs: DataFrame) -> DataFrame:
    """(repo_id, hash) of the commits that a remote reference, or one marked as trusted, reaches."""
    remote = refs.where(F.col("name").startswith("refs/remotes/") | F.col("name").startswith("refs/tidemark/trusted"))
    return reachable(graph, remote.select("repo_id", F.col("object_hash").alias("hash")).distinct())
