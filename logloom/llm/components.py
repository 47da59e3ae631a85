"""Connected components of an edge table: smallest labels spread along edges, and labels take their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sized


def components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """``node, label`` (the smallest node of the component) of every node in ``a, b``; the labels stay in tables.

    After ``steps`` steps, if given, labels may still tell parts of a component apart, but never join two components.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while steps is None or steps > 0:
        steps = None if steps is None else steps - 1
        small = sized(labels)
        near = both.join(small.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = near.join(small, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = small.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        moved = saved(lower.join(jump, "low").select("node", F.col("lower").alias("label"), (F.col("lower") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if steps is None and moved.filter("moved").isEmpty():
            break
    return labels
