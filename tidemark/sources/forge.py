"""Repository listings of hosting services, as rows: filtered, deduplicated and ordered. Fetching them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTING = "full_name string, path_with_namespace string, name string, clone_url string, ssh_url string, http_url_to_repo string, private boolean, visibility string, fork boolean, owner string, place long"


def listed(rows: DataFrame, forge: str, protocol: str = "https", visibility: str = "public", include_forks: bool = False, own: DataFrame | None = None, account: str = "") -> DataFrame:
    """(source, name, visibility, fork, forge) of a listing; of equal sources the last row by ``place`` counts.

    ``own`` is the listing that a signed-in account gets, of which the rows of this account are added after the others unless only public ones are wanted.
    """
    if "place" not in rows.columns or own is not None and "place" not in own.columns:
        raise ValueError("a listing needs the place of each row")
    rows = rows.withColumn("place", F.struct(F.lit(0).alias("list"), F.col("place").cast("long").alias("at")))
    if own is not None and visibility != "public":
        mine = own.where(F.lower("owner") == account.casefold()).withColumn("place", F.struct(F.lit(1).alias("list"), F.col("place").cast("long").alias("at")))
        rows = rows.unionByName(mine, allowMissingColumns=True)
    private = F.coalesce("private", F.lit(False)) | F.coalesce(F.col("visibility") == "private", F.lit(False))
    source = F.trim(F.coalesce(F.nullif("ssh_url" if protocol == "ssh" else "clone_url", F.lit("")), "http_url_to_repo", F.lit("")))
    name = F.coalesce(F.nullif("full_name", F.lit("")), F.nullif("path_with_namespace", F.lit("")), F.nullif("name", F.lit("")), source)
    made = rows.select(
        source.alias("source"),
        name.alias("name"),
        F.when(private, "private").otherwise("public").alias("visibility"),
        F.when(F.coalesce("fork", F.lit(False)), "yes").otherwise("no").alias("fork"),
        F.lit(forge).alias("forge"),
        "place",
    ).where("source <> ''")
    if visibility != "all":
        made = made.where(F.col("visibility") == visibility)
    if not include_forks:
        made = made.where("fork = 'no'")
    last = made.groupBy("source").agg(F.max_by(F.struct("source", "name", "visibility", "fork", "forge"), "place").alias("r")).select("r.*")
    return last.orderBy(F.lower("name"), "source")
