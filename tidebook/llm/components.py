"""Connected components of a graph of links, as joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept, with_least

#: Nodes whose least neighbours are broadcast, some 10 MB; those of more nodes are joined by shuffle.
FEW = 1 << 16


def _stars(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Links every node's neighbours to the least of them: the larger neighbours, or the smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    j = both.join(F.broadcast(both.groupBy("a").agg(F.min("b").alias("low"))), "a") if few else with_least(both, "a", "b", "low", "b")
    j = j.select("a", "b", F.least("a", "low").alias("m"))
    if large:
        return j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(j.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _shape(edges: DataFrame) -> tuple[int, int]:
    """(the number of nodes, that of the ones with several smaller neighbours, or with smaller and larger ones)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return tuple(nodes.agg(F.count(F.lit(1)), F.count_if(F.expr("down + up > 1 and down > 0"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its least node.

    Each round is a groupBy and a join, with the links of a hub in several parts; nothing is gathered on the driver but
    two counts, and no least neighbours of more than FEW nodes. Rounds end as soon as every node has one smaller
    neighbour, which has none itself: so links that are stars already take none. Their number grows with the logarithm
    of the number of nodes.
    """
    pair = F.when(F.col("a") > F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = kept(links.filter("a != b").select(pair.alias("p")).select("p.a", "p.b").distinct(), "links")
    nodes, crooked = _shape(edges)
    while crooked:
        new = kept(_stars(_stars(edges, True, nodes <= FEW), False, nodes <= FEW), "stars")
        forget(edges)
        edges = new
        nodes, crooked = _shape(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
