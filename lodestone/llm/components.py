"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of each batch by stars to the least node of their local component."""
    for batch in batches:
        parent: dict = {}

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for a, b in zip(batch["a"], batch["b"], strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pd.DataFrame({"a": [x for x, _ in pairs], "b": [r for _, r in pairs]})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reachable.

    `edges` has columns a and b of one comparable type; loops, repeats and nulls are ignored.
    Nothing is collected: each round is two aggregations and two joins on edge lists, ended when
    the edge list no longer changes, and cut from its lineage by a table in the shared folder. The
    tables of former rounds are deleted; discard() deletes the one that the result reads.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    edges = edges.mapInPandas(_forest, f"a {kind}, b {kind}")
    edges = materialize(edges.distinct())
    mark = None
    for _ in range(max_rounds):
        # large-star: each node hands its larger neighbours to its least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct())
        # small-star: each node and its smaller neighbours go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, edges = edges, materialize(small.where("a <> b").distinct())
        discard(before, large, shuffles=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    out.lodestone_path = edges.lodestone_path
    return out
