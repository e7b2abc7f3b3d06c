"""Checks that give a verdict column instead of stopping a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import verbatim_span


def scope_reason(name: Column, terms: Column, limit: Column, first: Column, last: Column) -> Column:
    """Why a scope definition is invalid; null if it isn't."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "name").when(terms.isNull() | (F.size(terms) == 0), "terms").when(limit < 1, "limit").when(first > last, "dates")
    )


def one_target(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


def citable(first: Column, last: Column) -> Column:
    return F.coalesce(first.isNotNull() & last.isNotNull() & (first > 0) & (last >= first), F.lit(False))


def acquire_status(content_type: Column, head: Column) -> Column:
    """parsed if the bytes are a PDF that says so, else abstract_only; failed without an answer."""
    return F.when(content_type.isNull(), "failed").when(F.contains(F.lower(content_type), F.lit("pdf")) & head.startswith("%PDF-"), "acquired").otherwise("abstract_only")


def judgement_errors(judged: DataFrame, opened: DataFrame) -> DataFrame:
    """Nodes that were not judged exactly once, or with a relevance outside 0..100."""
    per = judged.groupBy("node").agg(F.count("*").alias("n"), F.bool_and(F.col("relevance").between(0, 100)).alias("fine"))
    joined = opened.select("node").withColumn("open", F.lit(True)).join(per, "node", "full_outer")
    reason = F.when(F.col("open").isNull(), "not opened").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("fine"), "relevance")
    return joined.select("node", reason.alias("reason")).where("reason is not null")


def validate_records(raw: DataFrame, payload: str, allowed: DataFrame) -> DataFrame:
    """JSON records -> (record, node_id, claim_text, reason); reason is null for accepted ones."""
    one = "struct<node_id:bigint,claim_text:string>"
    parsed = raw.select("record", F.from_json(F.col(payload), one).alias("r")).select("record", "r.node_id", "r.claim_text")
    known = allowed.select(F.col("node_id"), F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("node_id").isNull(), "node_id").when(F.col("known").isNull(), "unknown node").when(F.col("claim_text").isNull() | (F.trim("claim_text") == ""), "claim_text")
    return parsed.join(known, "node_id", "left").select("record", "node_id", "claim_text", reason.alias("reason"))


def link_verdicts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """`links` (tree_node_id, rationale and other columns) with a verdict: the rationale has to stand in its node's body, but for white space."""
    found = links.join(nodes.select("tree_node_id", F.col("body").alias("_body")), "tree_node_id", "left")
    verdict = F.when(F.col("_body").isNull(), "unknown node").when(verbatim_span("_body", "rationale").isNull(), "no verbatim rationale").otherwise("ok")
    return found.withColumn("verdict", verdict).drop("_body")


def enough_citable(nodes: DataFrame, first: Column, last: Column, least: int = 2) -> DataFrame:
    """(question, n_citable, answerable): an answer needs at least `least` nodes whose pages are known."""
    return nodes.groupBy("question").agg(F.count_if(citable(first, last)).alias("n_citable")).withColumn("answerable", F.col("n_citable") >= least)
