"""Connected components of an edge table, by alternating star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serat.session import discard, durable


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node id of each component, for edges (a BIGINT, b BIGINT).

    Alternates large-star and small-star until nothing changes: O(log² n) rounds, each a shuffle of the edges, whose
    number never grows.  Nothing but one sum a round reaches the driver.  Self-loops and repeated edges are harmless,
    edges with a null end are ignored; an empty table gives no rows.
    """
    e = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    e = durable(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.toDF("a", "b").select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, e = e, durable(small.where("u <> v").distinct())
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return nodes.join(e.toDF("node", "c"), "node", "left").select("node", F.coalesce("c", "node").alias("component"))
