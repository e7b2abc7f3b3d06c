"""What changed since a moment: five independent categories, all strictly later than it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import latest, ranked


def _since(column: str, moment: datetime):
    return F.col(column) > F.lit(moment).cast("timestamp_ntz")


def new_papers(paper: DataFrame, paper_scope: DataFrame, topics: DataFrame, since: datetime) -> DataFrame:
    """`topics`: scope_id of each topic subscription; `paper` has created_at."""
    return paper.where(_since("created_at", since)).join(paper_scope, "paper_id").join(topics.select("scope_id"), "scope_id", "left_semi").select("scope_id", "paper_id", "created_at")


def new_evidence(evidence: DataFrame, watched: DataFrame, since: datetime) -> DataFrame:
    return evidence.where(_since("created_at", since)).join(watched.select("claim_id"), "claim_id", "left_semi").select("claim_id", "evidence_id", "stance", "created_at")


def stance_flips(evidence: DataFrame, watched: DataFrame, since: datetime) -> DataFrame:
    """First refuting evidence (least id) of watched claims that had none at the moment."""
    refutes = evidence.where("stance = 'refutes'").join(watched.select("claim_id"), "claim_id", "left_semi")
    before = refutes.where(~_since("created_at", since)).select("claim_id")
    fresh = refutes.where(_since("created_at", since)).join(before, "claim_id", "left_anti")
    return latest(fresh, ["claim_id"], [F.asc("evidence_id")]).select("claim_id", "evidence_id", "created_at")


def score_movement(score: DataFrame, since: datetime, threshold: int = 10) -> DataFrame:
    """The two latest scores of each claim, if the latest is new and either score moved enough.

    The two deltas are kept apart.
    """
    two = ranked(score, ["claim_id"], [F.desc("scored_at"), F.desc("score_id")]).where("rank <= 2")
    pick = lambda col, k: F.max(F.when(F.col("rank") == k, F.col(col)))
    wide = two.groupBy("claim_id").agg(
        pick("scored_at", 1).alias("scored_at"), pick("confidence", 1).alias("confidence"), pick("confidence", 2).alias("old_confidence"),
        pick("evidence_quality", 1).alias("quality"), pick("evidence_quality", 2).alias("old_quality"), F.count("*").alias("n"),
    )
    moved = wide.where((F.col("n") == 2) & _since("scored_at", since)).select(
        "claim_id", "scored_at", (F.col("confidence") - F.col("old_confidence")).alias("confidence_delta"), (F.col("quality") - F.col("old_quality")).alias("quality_delta")
    )
    return moved.where((F.abs("confidence_delta") >= threshold) | (F.abs("quality_delta") >= threshold))


def new_mentions(mention: DataFrame, evidence: DataFrame, watched: DataFrame, since: datetime) -> DataFrame:
    """Mentions of papers that back a watched claim."""
    backing = evidence.join(watched.select("claim_id"), "claim_id", "left_semi").select("claim_id", "paper_id").distinct()
    return mention.where(_since("created_at", since)).join(backing, "paper_id").select("claim_id", "paper_id", "mention_id", "created_at")
