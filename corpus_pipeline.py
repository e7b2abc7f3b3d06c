"""A training corpus from raw documents, in five stages of corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. Stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import has_table, materialize, table
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.minhash_dedup import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.quality import fitted_quality, quality
from lodestone.llm.suffix_dedup import remove_repeats, row_key

#: Two of the stages are not SQL (near-duplicate links, a tokeniser); tests hold the pipeline
#: against brute force instead.
ORACLE_SQL: str | None = None


def own_key() -> Column:
    """128 bits of a row's id and text."""
    return F.struct(*row_key("doc_id", "text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the tokenisers' bands; those of languages are fitted on `labels`, if there.

    Rows are judged one by one, repeated ids, null ids and repeated rows alike; null and empty texts
    go, as they have too few words. Extra columns stay.
    """
    # the whole row goes along as the id: no join is needed, and no name can clash
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    judged = fitted_quality(rows, table(spark, sf_dir, "labels"), "row", key="id.doc_id", passed=True) if has_table(spark, sf_dir, "labels") else quality(rows, "row")
    return judged.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, null ids last.

    Rows that repeat both id and text are one document, of which one row stays; rows that repeat
    the id alone are documents of their own. Null and wordless texts are near to nothing and stay.
    """
    # a row's own id, ordered by doc_id with nulls last; without null fields, so that null ids are linked too
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", zero).alias("doc"), own_key().alias("key"))
    judged = near_duplicates(docs.select(own.alias("own"), "text"), id_col="own")
    gone = judged.where("not kept").select("own.key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), own_key().alias("key"))
    return keyed.join(gone, "key", "left_anti").dropDuplicates(["key"]).select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere; n_chars follows the text where that was cut.

    Every row stays. Rows that repeat both id and text cut each other, as their texts stand twice.
    """
    rest = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs.select(F.struct(*rest).alias("row"), "doc_id", "text"), id_col="row", key_col="doc_id")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a passage of the benchmark. Rows are judged by id and text; null texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences. A null text is the end token alone; repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
