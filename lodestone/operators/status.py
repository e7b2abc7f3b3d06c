"""Corpus status, subscriptions and sweep states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope_status(scope: DataFrame, paper_scope: DataFrame, paper: DataFrame, section_counts: DataFrame) -> DataFrame:
    """Counts for each scope, zeros where it has nothing."""
    joined = scope.select("scope_id", "scope_name").join(paper_scope, "scope_id", "left").join(paper.select("paper_id", "parse_status"), "paper_id", "left").join(section_counts, "paper_id", "left")
    state = lambda s: F.count_if(F.col("parse_status") == s)
    return joined.groupBy("scope_id", "scope_name").agg(
        F.count("paper_id").alias("papers"), state("parsed").alias("parsed"), state("abstract_only").alias("abstract_only"), state("failed").alias("failed"), F.coalesce(F.sum("sections"), F.lit(0)).alias("sections")
    )


def failed_papers(paper: DataFrame, paper_scope: DataFrame, scope: DataFrame) -> DataFrame:
    return paper.where("parse_status = 'failed'").join(paper_scope, "paper_id").join(scope.select("scope_id", "scope_name"), "scope_id").select("scope_name", "paper_id", "title")


def over_ceiling(paper_scope: DataFrame, ceiling: int = 1000) -> DataFrame:
    return paper_scope.groupBy("scope_id").agg(F.count("*").alias("papers")).withColumn("at_ceiling", F.col("papers") >= ceiling)


def sweep_state(attempted: Column, errors: Column, found: Column) -> Column:
    """Skipped sources count as neither attempted nor failed."""
    return F.when(attempted == 0, "completed").when((errors == attempted) & (found == 0), "failed").when(errors > 0, "completed_with_errors").otherwise("completed")


def subscriptions(topics: DataFrame, claims: DataFrame, scope: DataFrame) -> DataFrame:
    """Both kinds with a label: the scope's name or else the id."""
    topic = topics.select(F.lit("topic").alias("kind"), F.col("scope_id"), F.lit(None).cast("long").alias("claim_id"))
    claim = claims.select(F.lit("claim").alias("kind"), F.lit(None).cast("long").alias("scope_id"), F.col("claim_id"))
    both = topic.unionByName(claim).join(scope.select("scope_id", "scope_name"), "scope_id", "left")
    return both.select("kind", "scope_id", "claim_id", F.coalesce("scope_name", F.col("scope_id").cast("string"), F.concat(F.lit("claim #"), F.col("claim_id").cast("string"))).alias("label"))


def duplicate_subscriptions(wanted: DataFrame, claim: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted claims whose canonical root is watched already."""
    rooted = claim.select("claim_id", F.coalesce("canonical_claim_id", "claim_id").alias("root_id"))
    held = existing.join(rooted, "claim_id").select("root_id").distinct()
    return wanted.join(rooted, "claim_id").join(held, "root_id", "left_semi").select("claim_id", "root_id")


#: Papers in one of these states have something to read.
READABLE = ("parsed", "abstract_only")


def eligible_papers(paper: DataFrame) -> DataFrame:
    return paper.where(F.col("parse_status").isin(*READABLE)).select("paper_id", "parse_status")


def first_scope(paper_scope: DataFrame) -> DataFrame:
    """The least scope of each paper."""
    return paper_scope.groupBy("paper_id").agg(F.min("scope_id").alias("scope_id"))


def extraction_currency(paper: DataFrame, extracted: DataFrame, wanted: int = 1) -> DataFrame:
    """Whether a paper has claims of exactly as many kinds as wanted; `extracted`: paper_id, kind."""
    kinds = extracted.groupBy("paper_id").agg(F.countDistinct("kind").alias("_k"))
    return paper.select("paper_id").join(kinds, "paper_id", "left").select("paper_id", (F.coalesce("_k", F.lit(0)) == wanted).alias("current"))
