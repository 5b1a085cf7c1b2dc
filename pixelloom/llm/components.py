"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that a file holds, at least.
EDGES_A_FILE = 500_000


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, label`` (longs) for every node of ``edges`` (``a, b``: longs): the label is the smallest node reachable.

    In the large star each node ties its larger neighbours to its smallest one, in the small star its smaller ones;
    after some log-squared rounds every edge ends in the label.  The smallest neighbour of each node is found with
    partial minima and stored before the edges are joined to it: it is one row a node, so the join is broadcast or,
    where a node has very many edges, split by adaptive execution, and no node's edges are gathered in one task.
    Each round is written to the shared folder, which cuts the lineage, and the round before is removed; files are
    few where edges are few.  Loops and repeated edges are ignored; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pairs = scratch.store(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "pairs")
    mark, files = None, max(1, pairs.count() // EDGES_A_FILE)
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.store(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")).coalesce(files), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        parent = scratch.store(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "parent")
        small = large.join(parent, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.store(small.unionAll(parent.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "pairs")
        scratch.drop(pairs, least, parent)
        pairs, before = now, mark
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("node"), "label").distinct())
