"""Latest-per-key, distinct-on, merge and reconcile operators over append-only relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return ranked(df, keys, order, "_rank").where("_rank = 1").drop("_rank")


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of `incoming` that would be inserted: new keys only, the first row of each."""
    return latest(incoming, keys, order).join(current.select(*keys), keys, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after an insert-or-update: an incoming row replaces the whole current row of its key."""
    kept = current.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming)


def replace_partition(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows after all rows of each incoming key were deleted and the incoming ones inserted."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def reconcile(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, action): insert, delete, update or keep for each key of either side."""
    old = current.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return old.join(new, keys, "full_outer").select(*keys, action.alias("action"))


def reconcile_fifo(current: DataFrame, incoming: DataFrame, keys: list[str], current_id: str, incoming_id: str) -> DataFrame:
    """Match rows of equal identity first in, first out: (current id, incoming id, action)."""
    old = ranked(current.select(*keys, current_id), keys, [F.asc(current_id)], "_n")
    new = ranked(incoming.select(*keys, incoming_id), keys, [F.asc(incoming_id)], "_n")
    action = F.when(F.col(current_id).isNull(), "insert").when(F.col(incoming_id).isNull(), "delete").otherwise("keep")
    return old.join(new, [*keys, "_n"], "full_outer").select(current_id, incoming_id, action.alias("action"))


def match_first(candidates: DataFrame, known: DataFrame, first: str, second: str, id_col: str) -> DataFrame:
    """Id of the known row with the candidate's first key, else of the one with its second."""
    one = known.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(id_col).alias("_one"))
    two = known.where(F.col(second).isNotNull()).groupBy(second).agg(F.min(id_col).alias("_two"))
    return candidates.join(one, first, "left").join(two, second, "left").withColumn("matched_id", F.coalesce("_one", "_two")).drop("_one", "_two")


def with_dependents(actions: DataFrame, current_id: str, dependents: DataFrame) -> DataFrame:
    """Deletions of rows that others depend on are refused; `dependents` has the id column."""
    held = dependents.select(current_id).distinct().withColumn("_held", F.lit(True))
    joined = actions.join(held, current_id, "left")
    return joined.withColumn("action", F.when((F.col("action") == "delete") & F.col("_held"), "refuse").otherwise(F.col("action"))).select(actions.columns)


def insert_with_ids(current: DataFrame, incoming: DataFrame, id_col: str) -> DataFrame:
    """`incoming` with the ids after the greatest there is, without gaps; no task numbers more than its own rows."""
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    placed = settle(incoming.withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there were partitions
    starts = counts.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_n"))
    numbered = placed.withColumn("_part", part).withColumn("_at", within).join(starts, "_part")
    return numbered.select((F.lit(top) + F.col("_before") + F.col("_at")).alias(id_col), *incoming.columns)


def first_spellings(terms: DataFrame, term: str, order: str) -> DataFrame:
    """(name, n): of terms that differ in no more than case and outer spaces the first spelling, and how many there are."""
    key = F.lower(F.trim(term))
    return terms.groupBy(key.alias("_key")).agg(F.min_by(term, order).alias("name"), F.count("*").alias("n")).select("name", "n")


def ordered_lookup(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Known rows by `id`, each once for the place (pos) at which it is wanted; ids that nobody knows are left out."""
    return wanted.select("pos", "id").distinct().join(known, "id")
