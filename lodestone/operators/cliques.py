"""Groups in which every pair is accepted, merged in the order of the pairs, without a task for a large component.

The rule: pairs (smaller id, larger id) are taken in order; the groups of both sides become one if all
pairs across them are accepted. Between two groups some pairs across may be missing, and stay so, thus
what hasn't merged because of a gap never will; a state of the rule is a graph whose nodes are groups,
named by their least ids, and whose edges join groups without a gap. Two steps shrink that graph and
leave what the rule makes of it as it is:

* Twins, nodes with the same neighbours and each other: what takes the smaller one takes the other as
  soon as its turn comes. So a block of equal claims becomes one node at once.
* Nearest pairs, of which each is the other's least neighbour: nothing before their turn touches
  either. All of them merge at once; the edges of the new node are those that both had.

Components that have become small enough for a task are solved there in order. Rounds go on for the
larger ones; each merges at least one pair of every component. Where the order itself is a chain (a
path of ever larger ids) rounds grow with its length, as then one pair does depend on the one before.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import label_by_keys
from .scratch import drop, settle

#: Pairs of a component that one task may hold; rounds between two looks at the components.
TASK_PAIRS, ROUNDS = 200_000, 4


def _in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    """The rule itself on one component: counts of the accepted pairs between groups tell whether one is missing."""
    edges = sorted(zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True))
    between: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for a, b in edges:
        between[a][b] += 1
        between[b][a] += 1
    holds, home = {x: [x] for x in between}, {x: x for x in between}
    for a, b in edges:
        big, small = home[a], home[b]
        if len(holds[big]) < len(holds[small]):
            big, small = small, big
        if big == small or between[big][small] < len(holds[big]) * len(holds[small]):
            continue
        for x in holds[small]:
            home[x] = big
        holds[big] += holds.pop(small)
        for other, n in between.pop(small).items():
            del between[other][small]
            if other != big:
                between[big][other] += n
                between[other][big] += n
    return pd.DataFrame([(x, min(g)) for g in holds.values() for x in g if x != min(g)], columns=["x", "into"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))


def _twins(edges: DataFrame) -> DataFrame:
    """(x, into): nodes whose neighbours, themselves included, are those of a smaller node; told by 128 bits and their number."""
    around = _both_ways(edges)
    sign = [F.bit_xor(F.xxhash64(F.lit(k), "y")) for k in (1, 2)]
    own = [F.xxhash64(F.lit(k), "x") for k in (1, 2)]
    signed = around.groupBy("x").agg(F.count("*").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sign)])
    signed = signed.select("x", "n", *[F.col(f"s{k}").bitwiseXOR(own[k]).alias(f"s{k}") for k in (0, 1)])
    least = signed.groupBy("n", "s0", "s1").agg(F.min("x").alias("into"), F.count("*").alias("k")).where("k > 1")
    return signed.join(least, ["n", "s0", "s1"]).where("x <> into").select("x", "into")


def _nearest(edges: DataFrame) -> DataFrame:
    """(x, into): nodes whose least neighbour is smaller and has them as its own least neighbour."""
    least = _both_ways(edges).groupBy("x").agg(F.min("y").alias("y"))
    return least.join(least.select(F.col("x").alias("y"), F.col("y").alias("back")), "y").where("back = x and y < x").select("x", F.col("y").alias("into"))


def _merged(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """The edges after pairs of nodes became one: those for which no pair across is missing."""
    role = merges.select("x", "into").unionByName(merges.select(F.col("into").alias("x"), "into"))
    side = lambda end: role.select(F.col("x").alias(end), F.col("into").alias(f"{end}_into"))
    moved = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    p, q = F.coalesce("a_into", "a"), F.coalesce("b_into", "b")
    parts = F.when(F.col("a_into").isNull(), 1).otherwise(2) * F.when(F.col("b_into").isNull(), 1).otherwise(2)
    across = moved.where(p != q).select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), parts.alias("parts"))
    return across.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("parts").alias("parts")).where("n = parts").select("a", "b")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(gone.select(F.col("x").alias(end)), end, "left_anti")
    return edges.select("a", "b")


def canonical_groups(pairs: DataFrame, task_pairs: int = TASK_PAIRS, twins: DataFrame | None = None) -> DataFrame:
    """(canonical_id, claim_id) of every claim in a group of several; the least id of a group names it.

    `pairs` has left_id and right_id. Repeated pairs, in either order, count once; a claim paired with
    itself and null ids are left out. No pairs give no groups. `twins` (id, into) are claims known beforehand to have the pairs
    of a smaller one, and one with it: `pairs` are then those of the smaller ones alone, so copies need no pairs.
    """
    a, b = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    edges = settle(pairs.where("left_id is not null and right_id is not null and left_id <> right_id").select(a.alias("a"), b.alias("b")).distinct())
    home = _both_ways(edges).select(F.col("x").alias("claim_id"), F.col("x").alias("at"))
    if twins is not None:
        home = home.unionByName(twins.select(F.col("into").alias("claim_id"), F.col("into").alias("at"))).unionByName(twins.select(F.col("id").alias("claim_id"), F.col("into").alias("at")))
    home = settle(home.distinct())

    def move(merges: DataFrame) -> None:
        nonlocal home
        after = settle(home.join(merges.select(F.col("x").alias("at"), "into"), "at", "left").select("claim_id", F.coalesce("into", "at").alias("at")))
        drop(home)
        home = after

    def shrink(step, rest) -> None:
        """Let a step's merges take effect on the edges and on the claims."""
        nonlocal edges
        merges = settle(step(edges))
        if merges.limit(1).count():
            after = settle(rest(edges, merges))
            drop(edges)
            edges = after
            move(merges)
        drop(merges)

    while edges.limit(1).count():
        ties = edges.select(F.col("a").alias("x"), F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("key")))
        label = label_by_keys(ties, "x", "key")
        labelled = settle(edges.join(label.withColumnRenamed("x", "a"), "a"))
        sizes = labelled.groupBy("label").agg(F.count("*").alias("k"))
        small = labelled.join(sizes.where(F.col("k") <= task_pairs), "label", "left_semi")
        move(small.groupBy("label").applyInPandas(_in_order, "x long, into long"))
        large = settle(labelled.join(sizes.where(F.col("k") > task_pairs), "label", "left_semi").select("a", "b"))
        drop(labelled), drop(edges)
        edges = large
        for _ in range(ROUNDS):
            if not edges.limit(1).count():
                break
            shrink(_twins, _without)
            shrink(_nearest, _merged)
    drop(edges)
    held = home.groupBy("at").agg(F.count("*").alias("k")).where("k > 1").select("at")
    return home.join(held, "at", "left_semi").select(F.col("at").alias("canonical_id"), "claim_id")
