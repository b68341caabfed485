"""Connected components by alternating large-star and small-star steps; each step is one aggregation and one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.tables import drop_folder, write_table


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches. Null ends and loops are left out.

    Edges are kept as (node, smaller neighbour). Large-star links each larger neighbour of a node to its smallest
    neighbour, small-star each smaller one; both keep components whole, and the number of rounds grows with the
    logarithm of a component's diameter. Every round is written to the shared folder, so lost executors cost one round
    at most. A hub's edges are aggregated on the map side (min) and its join is split where AQE finds it skewed.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e, folder = write_table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:  # labels only fall, so a fixed point is reached
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(near, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after, to = write_table(small, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_folder(e.sparkSession, folder)
        e, folder = after, to
        if mark == before:
            break
        before = mark
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
