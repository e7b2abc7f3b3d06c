"""Connected components of things that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, settle

#: More rounds than any graph needs, as each doubles the reach of a label.
ROUNDS = 200


def label_by_keys(links: DataFrame, node: str, key: str) -> DataFrame:
    """(node, label): the least node reachable over shared keys. `links` has a row for each node and key.

    Each round hands every node the least label among its keys, and then that label's own label, so
    that the rounds grow with the logarithm of the longest chain. Ends when no label changes.
    """
    ties = settle(links.select(F.col(node).alias("n"), F.col(key).alias("k")).where("n is not null and k is not null").distinct())
    label = settle(ties.select("n", F.col("n").alias("label")).distinct())
    for _ in range(ROUNDS):
        low = ties.join(label, "n").groupBy("k").agg(F.min("label").alias("low"))
        best = ties.join(low, "k").groupBy("n").agg(F.min("low").alias("best"))
        step = best.join(label.withColumnRenamed("label", "was"), "n")
        jump = label.select(F.col("n").alias("best"), F.col("label").alias("far"))
        new = settle(step.join(jump, "best").select("n", F.col("far").alias("label"), (F.col("far") != F.col("was")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        drop(label)
        label = new
        if not moved:
            drop(ties)
            return label.select(F.col("n").alias(node), "label")
    raise RuntimeError("labels did not settle")
