"""Connected components by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b), for nodes other than that least one.

    Alternates two steps until stars are left: every node links its larger neighbours to its least neighbour, then
    its smaller ones and itself to it.  Minima are pre-aggregated before each shuffle; each round is written to the
    shared folder.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    last = f"{name}-0"
    for i in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = scratch.save(small.where("u <> v").distinct(), f"{name}-{i}")
        scratch.drop(last)
        last = f"{name}-{i}"
        # done when what is left are stars: no node with two others above it, none both above and below another
        ends = e.select("u", F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up")).distinct())
        if not ends.groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or ups > 0 and n > ups").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
