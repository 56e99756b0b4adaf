"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lookup, saved


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the edges ``a, b``; ``comp`` is its smallest node.

    Alternates large-star and small-star steps until nothing changes; both only hang
    nodes on smaller neighbours, so the work stays in proportion to the edges.  Nodes with more
    than a share of all edges meet their least neighbour by a broadcast (see ``lookup``), so one
    node may have most of the edges.  Each step is written out, so no lineage builds up.
    Edges with a null end and loops play no part; without edges there are no nodes.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), F.count("*").alias("uses")), "least")
        large = lookup(both, least, "a", "uses").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = saved(large, "large-star")
        below = saved(large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("uses")), "below")
        small = lookup(large, below, "a", "uses")
        small = small.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        small = saved(small.where("a <> b").distinct(), "small-star")
        # Done when every node hangs on one smaller node that hangs on none.
        ends = small.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs")))))
        each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
        if not each.agg(F.max(F.expr("hangs > 1 OR hangs > 0 AND least = 0"))).first()[0]:
            break
        edges = small
    roots = small.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return small.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
