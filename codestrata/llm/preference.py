"""Preference formatting: one shared prompt and a masked completion for each side of a pair.

The prompt is the longest run of first turns that the chosen and the rejected conversation share.
It is rendered once; the turns behind it are rendered for each side, and only the assistant's
count for the loss.  A rendered conversation is the prompt's rows and then those of one side, by
position; they stay rows, since a conversation can be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.scale import materialize

# Turns whose positions one task works out at once.
BUCKET_TURNS = 1024
ASSISTANT = "assistant"


def neighbours(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from a table of plain ones.

    Each conversation with an assistant's turn is chosen.  Its rejected counterpart has the same
    turns up to the last one of the assistant, and there the last answer of the conversation whose
    id differs in the lowest bit; without such an answer it ends before that turn.  Rows without an
    id are in neither, nor are conversations without an assistant's turn; turns without a number are
    in both; of several last answers the greatest text counts; repeated rows stay repeated; texts of
    any length stay rows; an empty table gives two empty ones.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").alias("role"),
        F.col("text").alias("text"),
    )
    answers = rows.filter(F.col("role") == ASSISTANT).filter("pair_id IS NOT NULL")
    last = answers.groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    # One row for each conversation, read four times.
    last = materialize(last, "last-answers")
    ends = last.select("pair_id", F.col("last.turn").alias("end"))
    other = last.select(
        F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"),
        F.col("last.text").alias("text"),
    )
    chosen = rows.join(ends.select("pair_id"), "pair_id", "left_semi")
    same = rows.join(ends, "pair_id").filter("turn IS NULL OR end IS NULL OR turn < end")
    answer = ends.join(other, "pair_id").select(
        "pair_id", F.col("end").alias("turn"), F.lit(ASSISTANT).alias("role"), "text"
    )
    return chosen, same.select("pair_id", "turn", "role", "text").unionByName(answer)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")),
        F.lit("\n<|end|>\n"),
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of all pairs from tables ``(pair_id, turn, role, text)``.

    ``(pair_id, part, position, role, rendered, loss, start, length)``: ``part`` is ``prompt``,
    ``chosen`` or ``rejected``; ``start`` counts the characters before the turn in its rendered
    conversation; ``loss`` is false where a token is masked.  Turns stand by turn, role and text,
    nulls first; repeated rows are turns each; null roles and texts are rendered as empty and are
    alike only to nulls; rows without a pair id are left out.  A pair that lacks a side has no
    prompt; equal sides have no completion.  Texts of any length are one row each; empty tables give
    no rows.  Other columns are left out.
    """
    sides = _side(chosen, True).unionByName(_side(rejected, False)).filter("pair_id IS NOT NULL")
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS), F.lit(-(1 << 62)))
    group, keys = ["pair_id", "is_chosen"], ["pair_id", "is_chosen", "bucket"]
    # Texts are shuffled and sorted once, for their places within the bucket, and stored with these.
    inside = W.partitionBy(*keys).orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = sides.withColumn("bucket", bucket).withColumns(
        {
            "within": F.count(F.lit(1)).over(inside),
            "chars": F.coalesce(F.sum("length").over(inside), F.lit(0)),
        }
    )
    placed = materialize(placed, "turns")
    sums = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"))
    before = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *keys,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    buckets = materialize(sums, "turn-buckets")

    # From here to the last join rows are narrow: a content is two numbers, 120 bits of its MD5.
    narrow = placed.select(*keys, "within", "a", "b").join(buckets.select(*keys, "first"), keys)
    narrow = narrow.select("pair_id", (F.col("first") + F.col("within")).alias("position"), "a", "b")
    places = narrow.groupBy("pair_id", "position").agg(
        ((F.count(F.lit(1)) == 2) & (F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))).alias("same")
    )
    prefix = places.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.col("same"), F.col("position"))), F.count(F.lit(1))).alias("prefix")
    )
    known = materialize(buckets.join(prefix, "pair_id"), "turn-prefixes")
    position = F.col("first") + F.col("within")
    in_prompt = position < F.col("prefix")
    part = F.when(in_prompt, "prompt").when(F.col("is_chosen"), "chosen").otherwise("rejected")
    return (
        placed.join(known, keys)
        .filter(F.col("is_chosen") | ~in_prompt)
        .select(
            "pair_id",
            part.alias("part"),
            position.alias("position"),
            "role",
            rendered(F.col("role"), F.col("text")).alias("rendered"),
            (~in_prompt & F.coalesce(F.col("role") == ASSISTANT, F.lit(False))).alias("loss"),
            (F.col("chars_before") + F.col("chars")).alias("start"),
            "length",
        )
    )


def _side(turns: DataFrame, is_chosen: bool) -> DataFrame:
    role, text = turns["role"], turns["text"]
    content = F.md5(F.concat_ws(":", *[
        F.when(c.isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit("."), c))
        for c in (role, text)
    ]))
    return turns.select(
        turns["pair_id"].cast("long").alias("pair_id"),
        F.lit(is_chosen).alias("is_chosen"),
        turns["turn"].cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.length(rendered(role, text)).cast("long").alias("length"),
        *[F.conv(F.substring(content, at, 15), 16, 10).cast("long").alias(c) for c, at in (("a", 1), ("b", 16))],
    )
