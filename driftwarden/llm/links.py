"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the label is the smallest node reachable.

    Each round joins every label to the smallest label next to it, and to that one's own choice, and
    draws the edges anew between labels; edges inside a label go. Rounds end when no edge is left,
    after about the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    first = True
    while edges.head(1):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("near"))
        chosen = stored(chosen.select("label", F.least("label", "near").alias("parent")), "chosen")
        up = chosen.select(F.col("label").alias("parent"), F.col("parent").alias("grand"))
        jumped = stored(chosen.join(up, "parent").select("label", F.col("grand").alias("parent")), "jumped")
        if first:
            labels = jumped.select(F.col("label").alias("node"), F.col("parent").alias("label"))
            first = False
        else:
            labels = labels.join(jumped, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        labels = stored(labels, "labels")
        ends = jumped.select(F.col("label").alias("a"), F.col("parent").alias("pa"))
        ends_b = jumped.select(F.col("label").alias("b"), F.col("parent").alias("pb"))
        edges = edges.join(ends, "a").join(ends_b, "b")
        edges = edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct()
        edges = stored(edges, "edges")
    return labels
