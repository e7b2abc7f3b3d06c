"""Evaluation of retrieval and extraction, micro-averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import ranked


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def retrieval_metrics(gold: DataFrame, retrieved: DataFrame, cited: DataFrame, k: int = 5) -> DataFrame:
    """gold(question, path), retrieved(question, path, rank), cited(question, path) -> recall_at_k, citation_precision."""
    pairs = gold.select("question", "path").distinct()
    top = retrieved.where(F.col("rank") <= k).select("question", "path").distinct().withColumn("hit", F.lit(1))
    recall = pairs.join(top, ["question", "path"], "left").agg(ratio(F.count("hit"), F.count("*")).alias("recall_at_k"))
    precision = cited.join(pairs.withColumn("hit", F.lit(1)), ["question", "path"], "left").agg(ratio(F.count("hit"), F.count("*")).alias("citation_precision"))
    return recall.withColumn("_one", F.lit(1)).join(precision.withColumn("_one", F.lit(1)), "_one").drop("_one")


def unsupported_rate(statements: DataFrame, cited: DataFrame) -> DataFrame:
    """statements(question, ids), cited(question, ids): share of statements that name no cited node."""
    joined = statements.join(cited.withColumnRenamed("ids", "valid"), "question", "left")
    bad = ~F.arrays_overlap("ids", F.coalesce("valid", F.array().cast("array<bigint>")))
    return joined.agg(ratio(F.count_if(bad), F.count("*")).alias("unsupported_rate"))


def greedy_match(gold: DataFrame, extracted: DataFrame, keys: list[str], gold_id: str, extracted_id: str) -> DataFrame:
    """One-to-one matches of equal keys, first with first: (gold id, extracted id)."""
    one = ranked(gold.select(*keys, gold_id), keys, [F.asc(gold_id)], "_n")
    two = ranked(extracted.select(*keys, extracted_id), keys, [F.asc(extracted_id)], "_n")
    return one.join(two, [*keys, "_n"]).select(gold_id, extracted_id)


def extraction_metrics(gold: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """gold(gold_id, keys, path, stance), extracted(extracted_id, keys, path, stance), one evidence each."""
    matched = greedy_match(gold, extracted, keys, "gold_id", "extracted_id")
    both = matched.join(gold.select("gold_id", F.col("path").alias("g_path"), F.col("stance").alias("g_stance")), "gold_id").join(extracted.select("extracted_id", "path", "stance"), "extracted_id")
    hits = both.agg(F.count("*").alias("m"), F.count_if(F.col("path") == F.col("g_path")).alias("span"), F.count_if(F.col("stance") == F.col("g_stance")).alias("stance"))
    sizes = gold.agg(F.count("*").alias("g")).withColumn("_one", F.lit(1)).join(extracted.agg(F.count("*").alias("e")).withColumn("_one", F.lit(1)), "_one")
    all_ = hits.withColumn("_one", F.lit(1)).join(sizes, "_one")
    p, r = ratio(F.col("m"), F.col("e")), ratio(F.col("m"), F.col("g"))
    return all_.select(
        p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"), ratio(F.col("span"), F.col("e")).alias("span_precision"), ratio(F.col("stance"), F.col("m")).alias("stance_accuracy")
    )


def missing_gold(gold: DataFrame, known: DataFrame) -> DataFrame:
    """Gold paths (scope_id, path) that no paper of the scope has."""
    return gold.join(known.select("scope_id", "path").distinct(), ["scope_id", "path"], "left_anti")
