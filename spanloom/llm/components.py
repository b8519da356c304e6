"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of an edge.

    ``edges`` has two columns of integers; order, repeats and loops don't matter. Neighbourhoods are
    never gathered: each star is a minimum (partially aggregated) joined back to its edges, so a
    node with very many neighbours splits like any skewed join. Each round is written to the shared
    folder; the rounds end when the edges stay the same.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    now = edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before, seen = None, None
    while True:
        round_ = Scratch(spark)
        now = round_(now, "components")
        if before:
            before.__exit__()
        before = round_
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
