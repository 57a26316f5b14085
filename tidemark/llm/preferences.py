"""Preference formatting: a prompt rendered once, and two completions with masks.

The longest common turn prefix of the chosen and the rejected conversation becomes the prompt; what follows in each is its
completion. Only what an assistant says, up to its end mark, is to be learned; a mask lists those spans of the completion.

Nulls, ties and odd rows: a null role or text is rendered as an empty one and equals only another null; a conversation without
a rejected one has its last assistant turn as completion and null for the rejected columns; equal conversations have
empty completions; rows without a conversation id are conversations of one turn each; turns that repeat a number follow each other by role and
text. A very long conversation or text is one row, as its rendered form is, and is read in one task. Other columns are ignored. Everything stays in
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
SIZE = "struct<head:int,body:int,learn:boolean>"
#: Turns that are added up together.
CHUNK = 256
OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """(start, stop), in code points, of what is to be learned of the rendered turns.

    Turns are added up in chunks, so that the arrays that grow are short: those within a chunk, and one number for each chunk.
    """
    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body"), (t["role"] == "assistant").alias("learn")))
    last = F.call_function("div", F.size(turns) - 1, F.lit(CHUNK)).cast("int")
    chunks = F.when(F.size(turns) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(sizes, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast(f"array<array<{SIZE}>>"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + turn["head"]
        grown = F.concat(state["spans"], F.array(F.struct(first.alias("start"), (first + turn["body"]).alias("stop"))))
        return F.struct((first + turn["body"]).alias("at"), F.when(turn["learn"], grown).otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    local = F.transform(chunks, lambda c: F.aggregate(c, empty, step))
    ahead = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("firsts")),
        lambda s, c: F.struct(F.aggregate(c, s["at"], lambda n, t: n + t["head"] + t["body"]).alias("at"), F.concat(s["firsts"], F.array(s["at"])).alias("firsts")),
        lambda s: s["firsts"],
    )
    moved = lambda l, first: F.transform(l["spans"], lambda x: F.struct((x["start"] + first).alias("start"), (x["stop"] + first).alias("stop")))
    return F.flatten(F.zip_with(local, ahead, moved))


def _after(turns: Column, prefix: Column) -> Column:
    return F.slice(turns, prefix + 1, F.greatest(F.lit(0), F.size(turns) - prefix))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(id, chosen, rejected), each an array of turns, to prompt, completions and masks."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    alone = F.greatest(F.lit(0), F.size("chosen") - 1)
    prefix = F.when(F.col("rejected").isNull(), alone).when(differs == 0, F.size("chosen")).otherwise(differs - 1)
    found = pairs.withColumn("prefix_turns", prefix.cast("int"))
    parts = found.select(
        "id",
        "prefix_turns",
        F.slice("chosen", F.lit(1), F.col("prefix_turns")).alias("_prefix"),
        _after(F.col("chosen"), F.col("prefix_turns")).alias("_won"),
        _after(F.col("rejected"), F.col("prefix_turns")).alias("_lost"),
    )
    return parts.select(
        "id",
        "prefix_turns",
        _render(F.col("_prefix")).alias("prompt"),
        _render(F.col("_won")).alias("chosen"),
        _spans(F.col("_won")).alias("chosen_spans"),
        _render(F.col("_lost")).alias("rejected"),
        F.when(F.col("_lost").isNotNull(), _spans(F.col("_lost"))).alias("rejected_spans"),
    )


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs (id, chosen, rejected) from plain conversations.

    The chosen side is a conversation up to its last assistant turn; the rejected side is the same with that turn's text taken from
    the conversation whose id differs in the last bit. Without such a text, or such a turn, there is no rejected side.
    """
    turns = conversations.select(F.col("conv_id").alias("id"), "turn", F.struct("role", "text").alias("said"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "said.role", "said.text")))
    whole = turns.where("id is not null").groupBy("id").agg(listed.alias("turns"))
    single = turns.where("id is null").select("id", F.array(F.struct("turn", "said.role", "said.text")).alias("turns"))
    whole = whole.unionByName(single).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    places = F.transform("turns", lambda t, k: F.when(t["role"] == "assistant", k + 1).otherwise(0))
    ends = whole.withColumn("last", F.coalesce(F.array_max(places), F.lit(0)))
    said = ends.withColumn("chosen", F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns")))
    said = said.withColumn("reply", F.when(F.col("last") > 0, F.try_element_at("turns", F.col("last"))["text"]))
    replies = said.where("id is not null and reply is not null").select(F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), F.col("reply").alias("other"))
    paired = said.join(replies, "id", "left")
    swap = F.transform("chosen", lambda t, k: F.when(k + 1 == F.col("last"), F.struct(t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    rejected = F.when((F.col("last") > 0) & F.col("other").isNotNull(), swap)
    return paired.select("id", F.col("chosen").cast(f"array<{TURN}>").alias("chosen"), rejected.cast(f"array<{TURN}>").alias("rejected"))
