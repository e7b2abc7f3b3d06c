"""Mixing sources to target weights: whole epochs, then a weighted sample without replacement up to the budget.

Targets: the sources share the words of the whole table by their weights; no target goes beyond
`most` times its source, and what is above is shared again by weight until none is. That is one level
L with target = least(most * source size, L * weight); it rises from round to round, each an aggregate
over the table of sources, until no further source is at its bound.

Sampling (Efraimidis and Spirakis): a document of quality weight w gets the key -ln(u) / w, with u in
(0, 1) from the MD5 of its id and text, so reruns agree. Every document is taken for as many complete
epochs as its source's target holds; the rest of the budget goes to the documents with the least keys,
and the last of these gives its first words only, so a source misses its target by less than a word.

Documents are sorted by source and key over all tasks (range partitions, so that a hot source is
split); the sums before a document are those of the ranges before its own, of which there are a few
for each source, and a running sum within source and range.

Cases: a null text has no words, and gives none; a source without words has the target 0. A null
source is one of its own, after all others. Rows that repeat each other are documents of their own,
of which either may be the last that is taken. An empty table gives an empty result. Very long texts
go through expressions only. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Weights of the sources in order, repeating; how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Sources whose names and targets may be broadcast, and the bytes of their names.
FEW_SOURCES, FEW_BYTES = 100_000, 4 << 20
#: Fixed value: 2^52, to which 13 hex digits are scaled.
STEPS = 1 << 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plain_quality(text: Column, size: Column) -> Column:
    """1 for prose; the more symbols a word, the less; short texts count half."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>{}\[\]=\\]")), F.lit(0))
    return F.when(size < 10, 0.5).otherwise(1.0) * size / (size + 4 * symbols + 1)


def draw(id_: Column, text: Column) -> Column:
    """A number in (0, 1) that id and text decide."""
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / STEPS


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Rows with their place in the order, from 0; no task holds more than its range of them. The names _n and _range are taken."""
    placed = materialize(df.orderBy(*order).withColumn("_n", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_n", 33).alias("_range")).agg(F.count("*").alias("_k"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = ranges.select("_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_n"))
    return placed.withColumn("_range", F.shiftright("_n", 33)).withColumn("_at", within).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_n", "_range", "_at", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size); sources take the weights by code point, nulls last."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    known = materialize(numbered(sources, F.asc_nulls_last("source")).select("source", "source_size", weight.cast("long").alias("weight")))
    whole = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, bound = 0.0, F.col("source_size") * most
    while whole:
        over = F.col("weight") * F.lit(level) > bound
        spent, shared = known.agg(F.coalesce(F.sum(F.when(over, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        risen = (whole - spent) / shared if shared else level
        if risen <= level:
            break
        level = risen
    return known.select("source", "source_size", F.least(bound.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, size, source_size, target, taken, epochs) for each row of `docs`; `quality` is the weight of a document, above 0."""
    text = F.col(text_col)
    size = word_count(text)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), draw(F.col(id_col), text).alias("u"), (plain_quality(text, size) if quality is None else quality).alias("w"))
    # documents without words give nothing; their weight must not be 0
    keyed = materialize(sized.select("id", "source", "size", F.when(F.col("size") > 0, -F.log("u") / F.col("w")).otherwise(0.0).alias("key"), F.monotonically_increasing_id().alias("n")))
    per_source = materialize(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).select(F.col("source").alias("its"), "source_size", "target"))
    # ids of one key are equal texts; n settles what is left, as a range can't split equal rows
    ranged = materialize(keyed.orderBy(F.asc_nulls_last("source"), "key", F.asc_nulls_last("id"), "n").select("id", "source", "size", F.monotonically_increasing_id().alias("place")))
    discard(keyed, shuffles=False)
    place_range = F.shiftright("place", 33)
    sums = ranged.groupBy("source", place_range.alias("range")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("its"), "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    few = per_source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("its")), F.lit(0))).first()
    small = few[0] <= FEW_SOURCES and few[1] <= FEW_BYTES
    starts = starts.join(F.broadcast(per_source) if small else per_source, starts["its"].eqNullSafe(per_source["its"])).select(starts["its"], "range", "start", "source_size", "target")
    within = Window.partitionBy("range", "source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("range", place_range).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = summed.join(starts, (summed["range"] == starts["range"]) & summed["source"].eqNullSafe(starts["its"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    extra = F.least(F.greatest(F.col("rest") - F.col("start") - F.col("before"), F.lit(0)), F.col("size"))
    return placed.withColumn("epochs", epochs).withColumn("rest", rest).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), "epochs")
