"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import ensure_checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``; the component is its smallest node.

    Each round takes the smallest label among neighbours and then the label of
    that label, so chains shrink by halves. Neighbour minima are partial
    aggregates: a node with very many edges sends one row per task. Labels are
    checkpointed every round, which keeps the lineage short and survives the loss
    of executors. Only one number per round reaches the driver.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:  # labels only get smaller, so this ends
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid")
        )
        jump = stepped.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        moved = stepped.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")).checkpoint()
        changed = moved.where(F.col("old") != F.col("label")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
