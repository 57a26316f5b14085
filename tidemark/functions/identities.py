"""Who wrote a commit: names and addresses, aliases, bots and keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.globs import like
from tidemark.functions.labels import UNKNOWN_AUTHOR


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def resolved(name: Column, email: Column, aliases: Sequence[Mapping[str, Any]] = (), bot_patterns: Sequence[str] = ()) -> Column:
    """struct(name, email, key, is_bot): the first alias that fits by address or name replaces both."""
    own_name = F.coalesce(F.nullif(_clean(name), F.lit("")), F.lit(UNKNOWN_AUTHOR))
    own_email = F.lower(_clean(email))
    to_name, to_email = F, F
    for alias in aliases:
        hit = F.lit(False)
        for p in alias.get("match_emails", ()):
            hit = hit | like(own_email, str(p).lower())
        for p in alias.get("match_names", ()):
            hit = hit | like(F.lower(own_name), str(p).lower())
        given = str(alias.get("name") or "").strip()
        to_name = to_name.when(hit, F.lit(given) if given else own_name)
        to_email = to_email.when(hit, F.lit(str(alias["email"]).strip().lower()) if alias.get("email") else own_email)
    made_name = own_name if to_name is F else to_name.otherwise(own_name)
    made_email = own_email if to_email is F else to_email.otherwise(own_email)
    source = F.when(made_email != "", made_email).otherwise(F.concat(F.lit("name:"), F.lower(made_name)))
    bot = matches_any(F.concat(made_name, F.lit(" <"), made_email, F.lit(">")), bot_patterns)
    return F.struct(made_name.alias("name"), made_email.alias("email"), stable_hash(source, 24).alias("key"), bot.alias("is_bot"))


def stable_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def anonymised(authors: DataFrame, key: str = "author_key") -> DataFrame:
    """(author_key, name, email): names numbered in the order of the keys, addresses blank.

    The rank of a key is the number of smaller ones. Keys are hashes, so they are dealt to ranges of their first digits, each range
    is ranked by itself, and the 4096 counts before it are added.
    """
    keys = authors.select(F.col(key).alias("author_key")).distinct().withColumn("range", F.substring("author_key", 1, 3))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = keys.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("author_key"))).join(counts, "range")
    number = (F.col("first") + F.col("own")).cast("string")
    return ranked.select("author_key", F.concat(F.lit("Autor "), F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0")).alias("name"), F.lit("").alias("email"))
