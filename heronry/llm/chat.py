"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are then rendered.

A logged conversation that is a proper prefix of a longer one is a snapshot
of it. Each turn's prefix gets a rolling hash of 128 bits, the running xor of
hashes of position, role and text in two lanes, by a window per conversation.
The hash of a whole conversation that occurs among the different proper
prefixes goes by an anti-join; of equal conversations the smallest id stays.
Only hashes meet in joins and groups, pre-aggregated, so a first turn or a
whole conversation that a third of the log shares is one row there.

Only column functions are used. Defined cases: rows of a null id are one
conversation; a null turn comes first, ties are ordered by role and text;
null role or text differs from an empty one and is rendered empty; a repeated
row is a turn of its own; marks of the template in a text are broken up; a very
long text is hashed and rendered whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with place, size of the conversation, and h1, h2 of the prefix that ends there."""
    by = Window.partitionBy("conv_id")
    order = by.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("place", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(by))
    told = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    lane = lambda k: F.bit_xor(F.xxhash64(F.lit(k), *told)).over(upto)
    return placed.withColumns({"h1": lane(1), "h2": lane(2)})


def maximal(prefixed: DataFrame) -> DataFrame:
    """(conv_id, n_same) of the conversations that stay; n_same counts equal ones."""
    whole = prefixed.filter("place = size").groupBy("size", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_same"))
    parts = prefixed.filter("place < size").select(F.col("place").cast("long").alias("size"), "h1", "h2").distinct()
    return whole.join(parts, ["size", "h1", "h2"], "left_anti").select("conv_id", "n_same")


def rendered_turn(role: Column, text: Column) -> Column:
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(BEGIN), plain(role), F.lit("\n"), plain(text), F.lit(END), F.lit("\n"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_same, text."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    prefixed = prefixes(turns)
    stay = maximal(prefixed).withColumnRenamed("conv_id", "stays")
    kept = prefixed.select("conv_id", "place", "role", "text").join(stay, F.col("conv_id").eqNullSafe(F.col("stays")))
    lines = F.array_sort(F.collect_list(F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("line"))))
    grouped = kept.groupBy("conv_id").agg(lines.alias("lines"), F.first("n_same").alias("n_same"))
    return grouped.select("conv_id", F.size("lines").cast("long").alias("n_turns"), "n_same", F.array_join("lines.line", "").alias("text"))
