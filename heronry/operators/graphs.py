"""Components and paths of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import ensure_checkpoints, fresh_path


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Ends the lineage as `cut` does, but by files that are read back, for rounds that join what they made before.

    A checkpoint keeps the size that was estimated for its plan. A join's is the
    product of its sides, so over rounds it has twice the digits each time, and
    after some thirty the driver fails by the number alone. Files have a size.
    """
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of `edges` (u, v); the component is its smallest node.

    Large-star and small-star in turns until nothing changes. Each is a
    minimum per node, combined before the shuffle, joined back to the edges:
    no neighbourhood is ever gathered. A loop (u, u) makes u a component.
    """
    alone = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            break
        seen = now
    found = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return alone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def resolve_chains(links: DataFrame, most: int = 40) -> DataFrame:
    """(k, root) of `links` (k, up), each k once: the end of its chain, by rounds that double what `up` spans.

    A chain that runs in a circle has no end, and its links are left out.
    """
    for _ in range(most):
        above = links.select(F.col("k").alias("up"), F.col("up").alias("__next"))
        moved = cut(links.join(above, "up", "left").select("k", F.coalesce("__next", "up").alias("up"), F.col("__next").isNotNull().alias("moved")))
        links = moved.select("k", "up")
        if moved.filter("moved").isEmpty():
            break
    return links.join(links.select(F.col("k").alias("up")), "up", "left_anti").select("k", F.col("up").alias("root"))


def paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, longest: int = 8) -> DataFrame:
    """(path, hops) from a source to a sink over at most `longest` edges (u, v), no node twice; sources and sinks have the column node."""
    front = sources.select(F.array("node").alias("path"))
    ended = None
    for hops in range(1, longest + 1):
        grown = front.withColumn("u", F.element_at("path", -1)).join(edges.select("u", "v"), "u").filter(~F.array_contains("path", F.col("v")))
        front = grown.select(F.concat("path", F.array("v")).alias("path"))
        done = front.join(sinks.select("node"), F.element_at("path", -1) == F.col("node"), "left_semi").select("path", F.lit(hops).cast("long").alias("hops"))
        ended = done if ended is None else ended.unionByName(done)
    return ended
