"""Connected components by contraction.

Each round every vertex points to its smallest neighbour (itself, if that is
smaller), pointers are followed to their roots, and the edges between roots go to
the next round. At least half of the vertices with an edge vanish each round, so
the rounds grow as the logarithm of the largest component. Tables of vertices and
edges stay in Spark and are written after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of ``edges`` (``a``, ``b``, both ways)."""
    pointers = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        up = pointers.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
        moved = written(pointers.join(up, F.col("root") == F.col("_at")).select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")))
        drop(pointers)
        pointers = moved
        if not pointers.where("moved").limit(1).count():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every vertex in ``links`` (``a``, ``b``: longs); the label is the component's smallest vertex.

    Direction, repeats and loops don't matter; no links give no rows. Null ends are
    ignored. Returns a written table.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    edges = written(links.union(links.select("b", "a")).where("a <> b").distinct())
    labels = None
    while edges.limit(1).count():
        roots = _roots(edges)
        own = roots.select(F.col("node").alias("_node"), "root")
        if labels is None:
            labels = written(roots.select("node", F.col("root").alias("label")))
        else:
            before, labels = labels, written(labels.join(own, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("root", "label").alias("label")))
            drop(before)
        one = edges.join(own, F.col("a") == F.col("_node")).select(F.col("root").alias("a"), "b")
        both = one.join(own, F.col("b") == F.col("_node")).select("a", F.col("root").alias("b"))
        before, edges = edges, written(both.where("a <> b").distinct())
        drop(before, roots)
    drop(edges)
    return written(links.sparkSession.createDataFrame([], "node long, label long")) if labels is None else labels
