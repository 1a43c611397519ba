"""Connected components of links, by alternating large and small stars.

Cases: a link given twice or both ways counts once, a link of a node with itself
counts for nothing, so a node without another link is not in the result. Links
need both ends. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node around: the larger neighbours, or the smaller ones and the node itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    around = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("u <> m").select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``node, root``: every linked node with the smallest node it reaches.

    A node's links are never gathered: each step is an aggregation and a join on
    one side with a row per node. The number of rounds grows with the logarithm
    of the longest path.
    """
    edges = cut_lineage(
        links.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    state = None
    while True:
        edges = cut_lineage(_stars(_stars(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
