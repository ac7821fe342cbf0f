"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import Scratch, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge, with the least node of its component.

    Each round takes the least label among neighbours, then the label of that label, so rounds grow with the logarithm of
    a component's diameter. Labels are written to the shared folder each round; nothing is collected but whether any label
    moved. Null ends make no edge; loops give their node a component of its own; repeated edges change nothing.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    spark = edges.sparkSession
    room = Scratch(spark, "components")
    both = room.stored(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    last = Scratch(spark, "labels")
    labels = last.stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        now = Scratch(spark, "labels")
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        root = labels.select(F.col("node").alias("of"), F.col("label").alias("up"))
        jumped = step.join(root, step["label"] == root["of"], "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        jumped, moved = now.counted(jumped, "labels", F.col("label") != F.col("old"))
        last.drop()
        labels, last = jumped.select("node", "label"), now
        if not moved:
            room.drop()
            return labels.withColumnRenamed("label", "component")


def merged_components(known: DataFrame | None, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of known components and further edges: only the components that the edges join are looked at
    anew. The ends of edges may be unknown so far; known None is no components."""
    if known is None:
        return connected_components(edges, src, dst)
    room = Scratch(edges.sparkSession, "merged")
    a, b = known.select(F.col("node").alias(src), F.col("component").alias("c1")), known.select(F.col("node").alias(dst), F.col("component").alias("c2"))
    between = edges.join(a, src, "left").join(b, dst, "left").select(F.coalesce("c1", src).alias("src"), F.coalesce("c2", dst).alias("dst")).where("src <> dst").distinct()
    joins = connected_components(room.stored(between, "between")).select(F.col("node").alias("of"), F.col("component").alias("now"))
    ends = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).where("node is not null").distinct()
    every = known.select("node", "component").union(ends.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
    out = stored(every.join(joins, every["component"] == joins["of"], "left").select("node", F.coalesce("now", "component").alias("component")), "components")
    room.drop()
    return out
