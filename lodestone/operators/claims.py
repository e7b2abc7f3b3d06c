"""Claim listing, detail and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import latest, ranked

#: Rows of evidence that a task counts, about.
TASK_ROWS = 250_000


def latest_score(score: DataFrame) -> DataFrame:
    return latest(score, ["claim_id"], [F.desc("scored_at"), F.desc("score_id")])


def replication(evidence: DataFrame) -> DataFrame:
    """Distinct supporting papers of each claim that has any."""
    return evidence.where("stance = 'supports'").groupBy("claim_id").agg(F.countDistinct("paper_id").alias("replication_count"))


def list_claims(
    claim: DataFrame, paper_scope: DataFrame, scope: DataFrame, score: DataFrame, evidence: DataFrame,
    scope_name: str | None = None, claim_type: str | None = None, min_confidence: int | None = None, min_quality: int | None = None,
) -> DataFrame:
    """Canonical claims with their latest scores; the two scores are filtered each on its own."""
    roots = claim.where("canonical_claim_id is null").select("claim_id", "claim_type", "paper_id")
    scopes = scope if scope_name is None else scope.where(F.col("scope_name") == scope_name)
    if claim_type is not None:
        roots = roots.where(F.col("claim_type") == claim_type)
    found = roots.join(paper_scope, "paper_id").join(scopes.select("scope_id"), "scope_id").join(latest_score(score).select("claim_id", "confidence", "evidence_quality"), "claim_id")
    if min_confidence is not None:
        found = found.where(F.col("confidence") >= min_confidence)
    if min_quality is not None:
        found = found.where(F.col("evidence_quality") >= min_quality)
    return found.join(replication(evidence), "claim_id", "left").select("claim_id", "claim_type", "paper_id", "confidence", "evidence_quality", F.coalesce("replication_count", F.lit(0)).alias("replication_count"))


def claim_detail(claim: DataFrame, paper: DataFrame, score: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per claim: its paper, latest scores, and its evidence by stance with the first supporting node."""
    by = evidence.groupBy("claim_id").agg(
        F.count("*").alias("n_evidence"), F.count_if(F.col("stance") == "supports").alias("n_supports"), F.count_if(F.col("stance") == "refutes").alias("n_refutes"), F.bool_or("is_direct").alias("any_direct"),
        F.min_by("tree_node_id", F.struct("evidence_id")).alias("first_node"),
    )
    return (
        claim.select("claim_id", "paper_id", "claim_type", "object_value").join(paper.select("paper_id", "title", "parse_status"), "paper_id").join(latest_score(score).select("claim_id", "confidence", "evidence_quality"), "claim_id")
        .join(by, "claim_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    )


def root_evidence(claim: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each claim's canonical root, for canonical and aliased claims alike.

    Evidence is counted by root before claims meet it, in tasks of a bounded number of rows.
    """
    roots = claim.select("claim_id", F.coalesce("canonical_claim_id", "claim_id").alias("root_id")).where("root_id is not null")
    mine = evidence.select(F.col("claim_id").alias("root_id"), "stance", "paper_id")
    tasks = 1 + max(claim.count(), mine.count()) // TASK_ROWS
    counted = mine.repartition(tasks, "root_id").groupBy("root_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("paper_id").alias("n_papers"), F.count_if(F.col("stance") == "supports").alias("n_supports"))
    rooted = roots.repartition(tasks, "root_id").groupBy("claim_id", "root_id").agg(F.count("*").alias("times"))
    met = rooted.join(counted, "root_id")
    return met.select("claim_id", "root_id", (F.col("n_evidence") * F.col("times")).alias("n_evidence"), "n_papers", (F.col("n_supports") * F.col("times")).alias("n_supports"))


def unlinked(claim: DataFrame, evidence: DataFrame) -> DataFrame:
    return claim.join(evidence.select("claim_id"), "claim_id", "left_anti").select("claim_id", "paper_id")


def keep_canonical_evidence(claim: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of the evidence of a group of claims, per paper the one to keep: the root's own first, then the least id."""
    rooted = claim.select("claim_id", F.coalesce("canonical_claim_id", "claim_id").alias("root_id"))
    grouped = evidence.join(rooted, "claim_id").withColumn("alias", F.col("claim_id") != F.col("root_id"))
    return latest(grouped, ["root_id", "paper_id"], [F.asc("alias"), F.asc("evidence_id")]).select("root_id", "paper_id", "evidence_id")


def stale_claims(claim: DataFrame, score: DataFrame, evidence: DataFrame, observed: DataFrame, traced: DataFrame) -> DataFrame:
    """Claims never scored, or with evidence of their root, observations, traces or a check of identity later than their score.

    `observed` and `traced` have claim_id and at; `claim` may have identity_checked_at. A comparison with a missing time is not true.
    """
    checked = F.col("identity_checked_at") if "identity_checked_at" in claim.columns else F.lit(None).cast("timestamp_ntz")
    rooted = claim.select("claim_id", F.coalesce("canonical_claim_id", "claim_id").alias("root_id"), checked.alias("checked"))
    last = lambda df, col, name, key="claim_id": df.groupBy(key).agg(F.max(col).alias(name))
    joined = (
        rooted.join(last(score, "scored_at", "scored"), "claim_id", "left")
        .join(last(evidence.withColumnRenamed("claim_id", "root_id"), "created_at", "linked", "root_id"), "root_id", "left")
        .join(last(observed, "at", "seen"), "claim_id", "left").join(last(traced, "at", "traced"), "claim_id", "left")
    )
    return joined.where("scored is null or scored < linked or scored < seen or scored < traced or scored < checked").select("claim_id", "root_id")


def repoint(claim: DataFrame, groups: DataFrame) -> DataFrame:
    """`claim` after groups (canonical_id, claim_id) were saved: duplicates and what hung on them point to the group's root."""
    moved = groups.where("claim_id <> canonical_id").select(F.col("claim_id").alias("_from"), F.col("canonical_id").alias("_to"))
    # claims that hang on none have nothing to look up, and would all meet in the task of the null key
    hung, free = claim.where("canonical_claim_id is not null"), claim.where("canonical_claim_id is null")
    above = hung.join(moved, F.col("canonical_claim_id") == F.col("_from"), "left").drop("_from").unionByName(free.withColumn("_to", F.lit(None).cast(moved.schema["_to"].dataType)))
    own = above.join(moved.withColumnRenamed("_to", "_own"), F.col("claim_id") == F.col("_from"), "left").drop("_from")
    return own.withColumn("canonical_claim_id", F.coalesce("_own", "_to", "canonical_claim_id")).select(claim.columns)


def mark_checked(claim: DataFrame, ids: DataFrame, moment) -> DataFrame:
    """Claims among `ids` that have no time of their check get this one."""
    mine = ids.select("claim_id").distinct().withColumn("_hit", F.lit(True))
    at = F.when(F.col("_hit"), F.coalesce("identity_checked_at", F.lit(moment).cast(claim.schema["identity_checked_at"].dataType))).otherwise(F.col("identity_checked_at"))
    return claim.join(mine, "claim_id", "left").withColumn("identity_checked_at", at).select(claim.columns)


def evidence_nodes(evidence: DataFrame, nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """Evidence with what its node (tree_node_id, node) and its paper (paper_id, paper) are called."""
    return evidence.join(nodes, "tree_node_id").join(papers, "paper_id").select("evidence_id", "claim_id", "node", "paper", "stance")


def take_apart(claim: DataFrame, changed: DataFrame) -> DataFrame:
    """(root_id, paper_id, claim_id) of groups with a member among `changed`: the claim that each paper's evidence goes back to."""
    rooted = claim.select("claim_id", "paper_id", F.coalesce("canonical_claim_id", "claim_id").alias("root_id"))
    hit = rooted.join(changed.select("claim_id"), "claim_id", "left_semi").select("root_id").distinct()
    return rooted.join(hit, "root_id", "left_semi").groupBy("root_id", "paper_id").agg(F.min("claim_id").alias("claim_id"))


def backed_mentions(mention: DataFrame, paper: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each mention with its paper's title and, of the claims the paper backs, the highest."""
    backed = evidence.groupBy("paper_id").agg(F.max("claim_id").alias("claim_id"))
    return mention.join(paper.select("paper_id", "title"), "paper_id").join(backed, "paper_id").select("mention_id", "source", "score", "title", "claim_id")


def number_citations(cited: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """(key, item, number): items numbered from 1 in the order in which they are first cited."""
    first = cited.groupBy(key, item).agg(F.min(order).alias("_first"))
    return ranked(first, [key], [F.asc("_first"), F.asc(item)], "number").select(key, item, F.col("number").cast("long").alias("number"))
