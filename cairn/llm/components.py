"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node of its component.

    Each round takes the least label among a node's neighbours, then the label of that label; both halve long chains,
    so rounds grow with the logarithm of a component's diameter. Sums and minima are partly made before each shuffle,
    so a node with very many edges is no hot spot. Tables between rounds are written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        now = stored(lower.join(jump, "label", "left").select("node", "was", F.coalesce(F.least("label", "beyond"), "label").alias("label")), "labels")
        labels = now.select("node", "label")
        if now.where("was <> label").isEmpty():
            return labels
