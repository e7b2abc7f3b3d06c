"""The two scores of a claim. They are computed apart and never combined."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens, verbatim_overlap
from .history import latest, ranked

#: Points of the factors, and ratios of their bands.
CONFIDENCE_POINTS = {"nodes": 25, "overlap": 25, "consistency": 20, "stopped": 20, "validation": 10}
STOPPED_RATIOS = {"sufficient_evidence": 1.0, "budget_exhausted": 0.25, "no_candidates": 0.0}
QUALITY_POINTS = {"full_text": 27, "peer_review": 22, "directness": 17, "recency": 17, "replication": 17}
FULL_TEXT_RATIOS = {"parsed": 1.0, "abstract_only": 0.25}
RECENCY_BANDS = [(2, 1.0), (5, 0.67), (10, 0.33)]
REPLICATION_BANDS = [(3, 1.0), (2, 0.5)]


def points(ratio: Column, weight: int) -> Column:
    """Ratio within 0..1 times weight, to four places, halves to even."""
    return F.bround(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * weight, 4)


def total(*parts: Column) -> Column:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return F.least(F.greatest(F.bround(whole, 0), F.lit(0.0)), F.lit(100.0)).cast("int")


def _lookup(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def age_years(published: Column, as_of: date) -> Column:
    """Never negative; null for unknown dates (greatest alone would pass over the null)."""
    days = F.datediff(F.lit(as_of), published.cast("date"))
    return F.when(days.isNotNull(), F.greatest(days / F.lit(365.2425), F.lit(0.0)))


def recency_ratio(age: Column) -> Column:
    """The first band whose limit is not passed; 0 beyond them and for unknown ages."""
    out = F.lit(0.0)
    for most, ratio in reversed(RECENCY_BANDS):
        out = F.when(age <= most, F.lit(ratio)).otherwise(out)
    return F.when(age.isNull(), F.lit(0.0)).otherwise(out)


def replication_ratio(papers: Column) -> Column:
    out = F.lit(0.0)
    for least, ratio in reversed(REPLICATION_BANDS):
        out = F.when(papers >= least, F.lit(ratio)).otherwise(out)
    return out


def confidence_inputs(claim: DataFrame, evidence: DataFrame, nodes: DataFrame, observation: DataFrame, trace: DataFrame, validation: DataFrame) -> DataFrame:
    """What the factors are made of, from the relations.

    `claim`: claim_id, canonical_claim_id, paper_id, claim_text, question, model, prompt; `evidence` counts for the claim's root if it
    supports; `nodes`: tree_node_id, body; `observation`: claim_id, observation_id, claim_text, of which the last of a claim is the claim
    itself; `trace`: question, created_at, trace_id, stopped_reason; `validation`: paper_id, model, prompt, accepted, rejected.
    """
    rooted = claim.select("claim_id", F.coalesce("canonical_claim_id", "claim_id").alias("root_id"), "paper_id", "claim_text", "question", "model", "prompt")
    backing = evidence.where("stance = 'supports'").select(F.col("claim_id").alias("root_id"), "tree_node_id").distinct().join(nodes.select("tree_node_id", "body"), "tree_node_id")
    # equal texts are held against a node's body once
    pairs = rooted.select("claim_id", "root_id", "claim_text").join(backing, "root_id").select("claim_id", "tree_node_id", verbatim_overlap("claim_text", "body").alias("overlap"))
    support = pairs.groupBy("claim_id").agg(F.count("*").alias("nodes"), F.max("overlap").alias("overlap"))
    earlier = ranked(observation.select("claim_id", "observation_id", F.col("claim_text").alias("said")), ["claim_id"], [F.desc("observation_id")]).where("rank > 1 and trim(said) <> ''")
    alike = earlier.join(rooted.select("claim_id", "claim_text"), "claim_id").groupBy("claim_id").agg(F.avg(jaccard(F.array_distinct(tokens(F.col("claim_text"))), F.array_distinct(tokens(F.col("said"))))).alias("consistency"))
    last = latest(trace, ["question"], [F.desc("created_at"), F.desc("trace_id")]).select("question", "stopped_reason")
    joined = rooted.join(support, "claim_id", "left").join(alike, "claim_id", "left").join(last, "question", "left").join(validation, ["paper_id", "model", "prompt"], "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return joined.select("claim_id", zero("nodes", 0), zero("overlap", 0.0), zero("consistency", 0.0), zero("stopped_reason", "no_candidates"), zero("accepted", 0), zero("rejected", 0))


def isolated(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with the columns added, and `error` naming those that came out null; no row stops the others."""
    out = df.select("*", *[c.alias(k) for k, c in columns.items()])
    return out.withColumn("error", F.nullif(F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(k)) for k in columns]), F.lit("")))


def confidence_factors(claims: DataFrame) -> DataFrame:
    """`claims`: claim_id, nodes, overlap, consistency, stopped_reason, accepted, rejected."""
    checked = F.col("accepted") + F.col("rejected")
    p = CONFIDENCE_POINTS
    return claims.select(
        "claim_id", points(F.col("nodes") / F.lit(3.0), p["nodes"]).alias("nodes"), points(F.col("overlap"), p["overlap"]).alias("overlap"), points(F.col("consistency"), p["consistency"]).alias("consistency"),
        points(_lookup(F.col("stopped_reason"), STOPPED_RATIOS), p["stopped"]).alias("stopped"),
        points(F.when(checked > 0, F.col("accepted") / checked).otherwise(F.lit(0.0)), p["validation"]).alias("validation"),
    )


def confidence(factors: DataFrame) -> DataFrame:
    return factors.select("claim_id", total(*(F.col(c) for c in CONFIDENCE_POINTS)).alias("confidence"))


def quality_factors(claims: DataFrame, as_of: date) -> DataFrame:
    """`claims`: claim_id, parse_status, is_preprint, venue, published_at, any_direct, papers (supporting ones)."""
    p = QUALITY_POINTS
    reviewed = ~F.col("is_preprint") & F.col("venue").isNotNull()
    return claims.select(
        "claim_id", points(_lookup(F.col("parse_status"), FULL_TEXT_RATIOS), p["full_text"]).alias("full_text"), points(F.when(reviewed, F.lit(1.0)).otherwise(F.lit(0.0)), p["peer_review"]).alias("peer_review"),
        points(F.when(F.col("any_direct"), F.lit(1.0)).otherwise(F.lit(0.0)), p["directness"]).alias("directness"), points(recency_ratio(age_years(F.col("published_at"), as_of)), p["recency"]).alias("recency"),
        points(replication_ratio(F.col("papers")), p["replication"]).alias("replication"),
    )


def quality(factors: DataFrame) -> DataFrame:
    return factors.select("claim_id", total(*(F.col(c) for c in QUALITY_POINTS)).alias("evidence_quality"))


def snapshots(score: DataFrame) -> DataFrame:
    """Snapshots of confidence within its bounds, counted."""
    bounded = F.least(F.greatest("confidence", F.lit(0).cast("long")), F.lit(100).cast("long"))
    return score.groupBy("claim_id", bounded.alias("confidence")).agg(F.count("*").alias("snapshots"))


def validation_lookup(claim: DataFrame, counts: DataFrame) -> DataFrame:
    """Accepted and rejected records of each claim's paper, zeros if there are none."""
    return claim.select("claim_id", "paper_id").join(counts, "paper_id", "left").select("claim_id", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def trace_lookup(claim: DataFrame, trace: DataFrame, default: str = "no_candidates") -> DataFrame:
    """Why the latest traversal for each claim stopped; `trace`: claim_id, stopped_reason, created_at, trace_id."""
    last = trace.groupBy("claim_id").agg(F.max_by("stopped_reason", F.struct("created_at", "trace_id")).alias("_last"))
    return claim.select("claim_id").join(last, "claim_id", "left").select("claim_id", F.coalesce("_last", F.lit(default)).alias("stopped_reason"))
