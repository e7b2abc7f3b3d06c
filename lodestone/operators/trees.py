"""Section trees as adjacency lists: depth, order, ancestors, flattening and budgeted traversal.

Depth, order and flattening come from pointer doubling: each node keeps one pointer upwards and sums over the
way there, and each round it takes over the pointer and sums of the node it points to. So the rounds grow with the logarithm
of the height and the rows stay as wide as they were. Only ancestors() carries whole chains, which are its
result. Nodes on or below a cycle, a missing parent or a repeated node have no depth and are left out;
verdicts() says why, unreachable() names them. Nodes without an id are left out everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import root_segment
from .scratch import drop, settle


def _levels(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(t, n, depth, ancestors from the root down) of every node that hangs on a root."""
    known = nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("top"), F.when(F.col(parent).isNull(), F.array()).otherwise(F.array(parent)).cast("array<bigint>").alias("chain"))
    # top: the parent of the topmost node in the chain, which is yet to be found; lost: there is none
    known = settle(known.withColumn("lost", F.lit(False)))
    while known.where("top is not null").limit(1).count():
        up = known.select("t", F.col("n").alias("top"), F.col("top").alias("next"), F.col("chain").alias("above"), F.col("lost").alias("gone"))
        step = known.join(up, ["t", "top"], "left")
        chain = F.when(F.col("top").isNotNull() & F.col("above").isNotNull(), F.concat("above", "chain")).otherwise(F.col("chain"))
        step = step.select("t", "n", "next", chain.alias("chain"), (F.col("lost") | (F.col("top").isNotNull() & F.coalesce("gone", F.lit(True)))).alias("lost"))
        # a chain that meets itself is on a cycle or leads to one
        lost = F.col("lost") | (F.size(F.array_distinct("chain")) < F.size("chain")) | F.array_contains("chain", F.col("n"))
        step = step.select("t", "n", F.when(~lost, F.col("next")).alias("top"), F.when(lost, F.array().cast("array<bigint>")).otherwise(F.col("chain")).alias("chain"), lost.alias("lost"))
        before, known = known, settle(step)
        drop(before)
    return known.where("not lost").select("t", "n", F.size("chain").alias("depth"), F.col("chain").alias("ancestors"))


def _climb(links: DataFrame, sums: list[str]) -> DataFrame:
    """(t, n, end, *sums) of each node whose way up ends; links: (t, n, up, *sums), each (t, n) once.

    `up` is null where a way ends; a node's sums are those of the step to `up`, and are added along the way.
    `end` is the last node that exists, and `gone` whether it points to one that does not. Nodes
    whose way never ends are on or below a cycle: they are left when the steps outnumber a tree's nodes.
    """
    held = links.select("t", F.col("n").alias("up"), F.lit(True).alias("_held"))
    now = links.join(held, ["t", "up"], "left").withColumn("gone", F.col("up").isNotNull() & F.col("_held").isNull())
    now = settle(now.select("t", "n", F.when(~F.col("gone"), F.col("up")).alias("up"), F.coalesce(F.when(~F.col("gone"), F.col("up")), F.col("n")).alias("end"), "gone", *sums))
    most = now.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps <= most and now.where("up is not null").limit(1).count():
        above = now.select("t", F.col("n").alias("up"), F.col("up").alias("_up"), F.col("end").alias("_end"), F.col("gone").alias("_gone"), *(F.col(c).alias(f"_{c}") for c in sums))
        # rows whose way has ended don't meet anything, and are not shuffled
        done, going = now.where("up is null"), now.where("up is not null").join(above, ["t", "up"])
        moved = going.select("t", "n", F.col("_up").alias("up"), F.col("_end").alias("end"), F.col("_gone").alias("gone"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums))
        before, now = now, settle(done.unionByName(moved))
        drop(before)
        steps *= 2
    return now.where("up is null").drop("up")


def _plain(nodes: DataFrame, tree: str, node: str, parent: str, ordinal: str | None = None) -> DataFrame:
    """(t, n, p, o, k) of each node once: its least parent and ordinal, and how often it is there. Without nodes that have no id."""
    o = F.col(ordinal) if ordinal else F.col(node)
    rows = nodes.where(F.col(tree).isNotNull() & F.col(node).isNotNull()).select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"), o.alias("o"))
    return rows.groupBy("t", "n").agg(F.min("p").alias("p"), F.min("o").alias("o"), F.count("*").alias("k"))


def verdicts(nodes: DataFrame, tree: str = "paper_id", node: str = "node", parent: str = "parent", ordinal: str | None = None) -> DataFrame:
    """(tree, node, depth, pass, verdict) of each node once.

    verdict: `ok`; `missing parent` on or below a node whose parent does not exist; `repeated` on or below
    a node that is there more than once; else `cycle` on or below a cycle. Depth and pass are null unless ok.

    Siblings and trees are read in passes over the nodes by (ordinal, node), nulls first, each of which takes
    the nodes whose parents it or an earlier pass has taken. A node goes into its parent's pass
    if it comes after it, else into the next one, so its pass counts the steps backward on its way from the root.
    """
    base = settle(_plain(nodes, tree, node, parent, ordinal))
    up = base.where("k = 1").select("t", F.col("n").alias("p"), F.col("o").alias("po"))
    earlier = F.struct("o", "n") < F.struct("po", "p")
    links = base.where("k = 1").join(up, ["t", "p"], "left").select(
        "t", "n", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(F.col("p").isNotNull() & earlier, 1).otherwise(0).cast("long").alias("pass")
    )
    ended = _climb(links, ["depth", "pass"])
    # what the way ended at: a root, a repeated node, or nothing
    last = base.select("t", F.col("n").alias("p"), (F.col("k") > 1).alias("again"))
    ends = base.select("t", F.col("n").alias("end"), F.col("p"))
    why = ended.where("gone").join(ends, ["t", "end"]).join(last, ["t", "p"], "left").select("t", "n", F.when(F.col("again"), "repeated").otherwise("missing parent").alias("why"))
    well = ended.where("not gone").select("t", "n", "depth", "pass", F.lit("ok").alias("why"))
    found = well.unionByName(why, allowMissingColumns=True)
    verdict = F.when(F.col("k") > 1, "repeated").otherwise(F.coalesce("why", F.lit("cycle")))
    return base.join(found, ["t", "n"], "left").select(F.col("t").alias(tree), F.col("n").alias(node), "depth", "pass", verdict.alias("verdict"), "o")


def ordered(nodes: DataFrame, tree: str = "paper_id", node: str = "node", parent: str = "parent", ordinal: str | None = None) -> DataFrame:
    """(tree, node, depth, pass, position, verdict): verdicts() and the position of a node in its tree, from 0.

    Positions follow (pass, ordinal, node), so parents come before their children. They are null in a tree that has any
    node which is not ok: such a tree is refused as a whole. Rows are sorted by range over all tasks and numbered by the counts
    of the ranges before, so a tree that holds most rows is spread out.
    """
    judged = verdicts(nodes, tree, node, parent, ordinal)
    refused = judged.where("verdict <> 'ok'").select(tree).distinct().withColumn("_bad", F.lit(True))
    rows = judged.join(refused, tree, "left").repartitionByRange(tree, "pass", "o", node).withColumn("_range", F.spark_partition_id())
    rows = settle(rows)
    counts = rows.groupBy(tree, "_range").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(tree, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(tree, "_range").orderBy("pass", "o", node)) - 1
    placed = rows.withColumn("_within", within).join(counts, [tree, "_range"])
    position = F.when(F.col("_bad").isNull(), F.col("_before") + F.col("_within")).cast("long")
    return placed.select(tree, node, "depth", "pass", position.alias("position"), "verdict")


def depths(nodes: DataFrame, tree: str = "paper_id", node: str = "node", parent: str = "parent") -> DataFrame:
    links = _plain(nodes, tree, node, parent).where("k = 1").select("t", "n", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    return _climb(links, ["depth"]).where("not gone").select(F.col("t").alias(tree), F.col("n").alias(node), "depth")


def ancestors(nodes: DataFrame, tree: str = "paper_id", node: str = "node", parent: str = "parent") -> DataFrame:
    return _levels(nodes, tree, node, parent).select(F.col("t").alias(tree), F.col("n").alias(node), F.array_join(F.transform("ancestors", lambda x: x.cast("string")), "/").alias("ancestors"))


def unreachable(nodes: DataFrame, tree: str = "paper_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """Nodes on or below a cycle, or below a missing parent."""
    return nodes.join(depths(nodes, tree, node, parent), [tree, node], "left_anti")


def flatten(nodes: DataFrame, max_depth: int = 4, tree: str = "paper_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """Depth at most max_depth; deeper nodes hang on their ancestor one above that depth."""
    deep = settle(depths(nodes, tree, node, parent).select(F.col(tree).alias("t"), F.col(node).alias("n"), "depth").join(_plain(nodes, tree, node, parent).drop("o", "k"), ["t", "n"]))
    # ways end at the nodes that deeper ones may hang on
    links = deep.where(F.col("depth") >= max_depth - 1).select("t", "n", F.when(F.col("depth") >= max_depth, F.col("p")).alias("up"))
    ends = _climb(links, []).select("t", "n", "end")
    hang = F.when((F.col("depth") >= max_depth) & (F.lit(max_depth) > 0), F.col("end")).otherwise(F.col("p"))
    shallow = deep.join(ends, ["t", "n"], "left")
    return shallow.select(F.col("t").alias(tree), F.col("n").alias(node), F.least(F.col("depth"), F.lit(max_depth)).cast("long").alias("depth"), hang.cast("long").alias("parent"))


def roots(nodes: DataFrame, tree: str = "paper_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """Nodes without a parent among the given ones."""
    held = nodes.select(F.col(tree), F.col(node).alias(parent))
    orphans = nodes.where(F.col(parent).isNotNull()).join(held, [tree, parent], "left_anti").select(tree, node)
    return nodes.where(F.col(parent).isNull()).select(tree, node).unionByName(orphans)


#: Judges a batch: gets nodes with their place, adds expand (go on below) and sufficient (stop after this batch).
Judge = Callable[[DataFrame], DataFrame]


def expanded(nodes: DataFrame, budget: int, judge: Judge | None = None, walk: str | None = None, order: list[str] | None = None, tree: str = "paper_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """Nodes that a walk opens within a budget: (tree, node, depth, place, sufficient), and `walk` if given.

    The frontier is first in, first out: roots (nodes without a parent among the given ones) in
    `order`, by default tree and node; then the children of what was opened, in its order. A batch is
    the frontier as far as the budget goes. There is one budget, or one for each value of `walk`. A
    judge that isn't given is read from the columns expand and sufficient. A walk stops after a batch
    of which any node is sufficient.
    """
    order = order or [tree, node]
    group = F.col(walk) if walk else F.lit(0)
    base = settle(nodes.withColumn("_walk", group))
    keys = base.select(tree, F.col(node).alias(parent), F.lit(True).alias("_held"))
    front = base.join(keys, [tree, parent], "left").where("_held is null").drop("_held").withColumn("_above", F.lit(0).cast("long"))
    spent = None
    batches, depth, used_most = [], 0, 0
    while True:
        ordered = [F.col("_above"), *(F.col(c) for c in order)]
        if walk:
            left = F.lit(budget) if spent is None else F.lit(budget) - F.coalesce("_spent", F.lit(0))
            front = front if spent is None else front.join(spent, "_walk", "left")
            batch = front.withColumn("place", F.row_number().over(Window.partitionBy("_walk").orderBy(*ordered))).where(F.col("place") <= left)
            batch = batch.withColumn("place", F.col("place") + (F.lit(0) if spent is None else F.coalesce("_spent", F.lit(0)))).drop("_spent")
        else:  # at most `budget` rows are numbered in one task
            batch = front.orderBy(*ordered).limit(budget - used_most)
            batch = batch.withColumn("place", F.row_number().over(Window.orderBy(*ordered)) + used_most)
        batch = settle((judge or (lambda b: b))(batch).withColumn("depth", F.lit(depth).cast("long")))
        n = batch.count()
        if not n:
            break
        batches.append(batch)
        depth, used_most = depth + 1, used_most + n
        if not walk and used_most >= budget:
            break
        done = batch.groupBy("_walk").agg(F.bool_or("sufficient").alias("_done")).where("_done").select("_walk")
        going = batch.where("expand").join(done, "_walk", "left_anti").select("_walk", tree, F.col(node).alias(parent), F.col("place").alias("_above"))
        front = base.join(going, ["_walk", tree, parent])
        if walk:
            total = batch.groupBy("_walk").agg(F.max("place").alias("_spent"))
            spent = settle(total if spent is None else spent.unionByName(total).groupBy("_walk").agg(F.max("_spent").alias("_spent")))
    out = batches[0] if batches else batch
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.select(*([walk] if walk and walk != tree else []), tree, node, "depth", F.col("place").cast("long").alias("place"), "sufficient")


def stop_reasons(opened: DataFrame, budget: int, tree: str = "paper_id") -> DataFrame:
    """Why each walk ended: enough evidence, budget spent, or nothing left."""
    return opened.groupBy(tree).agg(F.count("*").alias("nodes_expanded"), F.bool_or("sufficient").alias("enough")).select(
        tree, "nodes_expanded", F.when(F.col("enough"), "sufficient_evidence").when(F.col("nodes_expanded") >= budget, "budget_exhausted").otherwise("no_candidates").alias("stopped_reason")
    )


def currency(nodes: DataFrame, wanted: DataFrame | int, tree: str = "paper_id") -> DataFrame:
    """Whether all nodes of a tree have one version and are as many as wanted: a number, or a frame (tree, wanted) whose trees without nodes aren't current."""
    found = nodes.groupBy(tree, "version").agg(F.count("*").alias("_k")).groupBy(tree).agg(F.count("*").alias("_versions"), F.sum("_k").alias("_nodes"))
    if isinstance(wanted, int):
        found = found.withColumn("wanted", F.lit(wanted))
    else:
        found = wanted.select(tree, "wanted").join(found, tree, "left")
    return found.select(tree, F.coalesce((F.col("_versions") == 1) & (F.col("_nodes") == F.col("wanted")), F.lit(False)).alias("current"))


def abstract_sections(paper: DataFrame, sections: DataFrame) -> DataFrame:
    """Papers of which only the abstract is known get one section, Abstract, if they have none."""
    has = sections.select("paper_id").distinct().withColumn("_has", F.lit(True))
    known = paper.where("parse_status = 'abstract_only'").join(has, "paper_id", "left")
    return known.select("paper_id", F.col("_has").isNull().alias("synthetic"), F.when(F.col("_has").isNull(), "Abstract").otherwise(F.col("title")).alias("path"))


def root_summaries(sections: DataFrame) -> DataFrame:
    """The whole bodies of each paper's root nodes, in the order of their nodes."""
    top = sections.where("parent is null").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("node", "body"))).alias("x"))
    return top.select("paper_id", F.array_join(F.transform("x", lambda e: e["body"]), " | ").alias("summary"))


def section_groups(sections: DataFrame) -> DataFrame:
    """(paper_id, root, first_node, nodes): sections by the first segment of their path; `sections`: paper_id, node, path."""
    return sections.select("paper_id", "node", root_segment(F.col("path")).alias("root")).groupBy("paper_id", "root").agg(F.min("node").alias("first_node"), F.count("*").alias("nodes"))


def sections_of(sections: DataFrame, venue: str) -> DataFrame:
    """The sections of a venue's papers with the lengths of their bodies."""
    return sections.where(F.col("venue") == venue).select("paper_id", "node", F.length("body").cast("long").alias("chars"))
