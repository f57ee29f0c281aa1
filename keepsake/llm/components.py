"""Connected components of an edge table, by alternating large and small stars.

Each round is two sums and two joins. A hub's rows are summed before they move. The joins are on the node's
complement, so that sums and edges are dealt anew for them and adaptive execution may split a hub's rows.
Rounds end in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u long, v long. Rows (node, label), label the least node of the component, for all nodes but the labels."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.withColumn("k", F.bitwise_not("u")).join(least, "k").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = least.select(F.bitwise_not("u").alias("k"), "m")
        small = large.withColumn("k", F.bitwise_not("u")).join(to_least, "k").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
