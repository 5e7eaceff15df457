"""Connected components of a graph of 64-bit nodes, in rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): the label is the smallest node of its component.

    Each round gives a node, and the node that it points to, the least grandparent among its neighbours, and then
    shortens the pointers; the number of rounds grows as the logarithm of a component's size. The least value of a
    node is found before the shuffle, and no group of nodes or edges is collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b"), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        known = stored(labels.select("node", "label").join(up, "label").select("node", "label", "above"), "known")
        least = both.join(known.select(F.col("node").alias("b"), "above"), "b").groupBy(F.col("a").alias("node")).agg(F.min("above").alias("least"))
        found = known.join(least, "node")
        told = found.select("node", F.least("least", "above").alias("to"), F.col("label").alias("old")).unionByName(
            found.select(F.col("label").alias("node"), F.col("least").alias("to"), F.lit(None).cast("long").alias("old"))
        )
        merged = told.groupBy("node").agg(F.min("to").alias("to"), F.max("old").alias("old"))
        after = stored(merged.select("node", F.least("to", "old").alias("label"), (F.col("to") < F.col("old")).alias("moved")), "labels")
        discard(labels)
        discard(known)
        labels = after
    discard(both)
    return labels.select("node", "label")
