"""Connected components by alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spherix.llm import common

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node of its component.

    Minima are aggregated before the shuffle and written, so that each join is between two plain shuffles,
    of which Spark can split the partition of a hub.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = common.written(pairs, "edges")
    mark = _mark(pairs)
    # each round's tables go when the next one's edges are there
    for _ in range(MAX_ROUNDS):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = common.written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        hubs = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(hubs, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, pairs = pairs, common.written(small.where("u <> v").distinct(), "edges")
        common.dropped(before, least, large, hubs)
        if (now := _mark(pairs)) == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v"), F.col("v")).distinct())
