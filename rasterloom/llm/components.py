"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Cuts


def components(edges: DataFrame, cut: Cuts) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node of its component.

    Every round each node takes the smallest root among its neighbours' and its own, and then that
    root's root; rounds end when no root changes, as they must: roots only fall, and a round in which none does
    is the last. Each round is cut, and the one before it deleted.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    roots, path = cut.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        seen = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("r"))
        near = roots.join(seen, roots.node == seen.a).select("node", "root", F.least("root", "r").alias("r"))
        up = roots.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new, new_path = cut.cut(near.join(up, "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("root"), F.col("root").alias("old")))
        changed = new.where("root != old").limit(1).count()
        cut.drop(path)
        roots, path = new.drop("old"), new_path
        if not changed:
            return roots
