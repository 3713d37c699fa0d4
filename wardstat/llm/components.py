"""Connected components of a links table by alternating large-star and small-star steps.

Links never leave Spark: each step is a partial aggregate by node and a join,
written to the shared folder. A node with very many links costs one partial
row per task in the aggregate, and its side of the join can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.tables import written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, both long), where
    ``component`` is the smallest node that links reach. Self links and repeats
    are fine; nodes without links aren't in the result."""
    edges = _forward(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    edges = written(edges, "links")
    for _ in range(MAX_ROUNDS):
        if not edges.limit(1).count():
            break
        # every node's smallest neighbour, itself included
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: a's larger neighbours are linked to a's smallest
        large = written(_forward(edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "links")
        # small star: a (the larger end) and its smaller neighbours are linked to its smallest
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(least, "b")
        small = joined.select("a", F.col("low").alias("b")).unionByName(least.select(F.col("b").alias("a"), F.col("low").alias("b")))
        new = written(_forward(small), "links")
        # done when all links are stars: no node is both a centre and a leaf
        centres, leaves = new.select("a"), new.select(F.col("b").alias("a"))
        if not centres.join(leaves, "a", "left_semi").limit(1).count() and not new.groupBy("b").count().where("count > 1").limit(1).count():
            edges = new
            break
        edges = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node")).distinct()
    return roots.select("node", F.col("node").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    )


def _forward(edges: DataFrame) -> DataFrame:
    """Distinct links with the smaller node first, no self links."""
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
