"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; a step's edges are written to the shared folder, so that plans stay short and
lost executors lose nothing. The number of edges never grows, and no node's neighbours are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import written

#: Rounds after which the input can't be a graph of any real size: each about halves the longest path.
MOST_ROUNDS = 100


def _least(pairs: DataFrame) -> DataFrame:
    """(node, near) to (node, near, least), least being the smallest of a node and its neighbours."""
    found = pairs.groupBy("node").agg(F.min("near").alias("least"))
    return pairs.join(found.select("node", F.least("node", "least").alias("least")), "node")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, to (node, component): every node of an edge and the smallest node it reaches."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, mark = written(links), None
    for _ in range(MOST_ROUNDS):
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
        large = _least(both).where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        small = _least(large.select(F.col("a").alias("node"), F.col("b").alias("near")))
        small = small.select(F.explode(F.array(F.struct(F.col("near").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))).alias("e"))
        links = written(small.select("e.a", "e.b").where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
