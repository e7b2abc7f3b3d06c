"""Benchmark decontamination by word windows, with DataFrame functions only.

Windows of SIZE consecutive normalised words of each benchmark item (all words of a shorter item)
form the set to look for. A window of a document holds exactly one run of GRAM words that starts
at a multiple of SIZE - GRAM + 1, so only those runs are hashed and looked up in a map of the runs in
the set, which travels with the tasks. It has SPARE slots for each window, counted, and between
LEAST_SLOTS and MOST_SLOTS of them (a byte each); a set that outgrows it has more windows looked up in
vain, and the same hits. The few windows around a run that passes are joined with the set on their whole text, which is the
verification; the set is broadcast while it has at most MAX_SET windows, which is counted, and
joined by shuffle beyond. The words that hits cover are merged per document.

Normalised words: runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased.

Cases: null or wordless texts have no words and no hits; null or wordless items have no windows.
Repeated rows give repeated results (they are counted and dealt out again). Equal items share
their windows, and each counts. Extra columns are ignored. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SIZE = 13
GRAM = 5
#: Size of the map (a byte a slot); each run of words has two slots.
LEAST_SLOTS, MOST_SLOTS, SPARE = 1 << 17, 1 << 24, 16
#: The eight slots of a byte of eight bits, the lowest first.
_UNPACKED = [bytes(b >> k & 1 for k in range(8)) for b in range(256)]
#: Windows that may be broadcast, of some hundred bytes each.
MAX_SET = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(window, width, items): the distinct windows, with the sorted ids that have them."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("words")).where("size(words) > 0")
    words = words.withColumn("width", F.least(F.size("words"), F.lit(size)))
    each = words.select("item", "width", F.expr("explode(transform(sequence(1, size(words) - width + 1), p -> array_join(slice(words, p, width), ' ')))").alias("window"))
    return each.groupBy("window", "width").agg(F.sort_array(F.collect_set("item")).alias("items"))


def slots_for(n_windows: int) -> int:
    """A power of two."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SPARE * n_windows - 1).bit_length()))


def _slots(h: Column, slots: int) -> list[Column]:
    return [h.bitwiseAND(slots - 1).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(slots - 1).cast("int")]


def _map(windows: DataFrame, width: int, gram: int, slots: int) -> bytes:
    """Which slots are taken by the runs of `gram` words of the windows; gathered as bitmaps of 4 KB."""
    runs = windows.where(F.col("width") == width).select(F.split("window", " ").alias("w"))
    runs = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(width - gram + 1)), lambda p: F.xxhash64(F.slice("w", p, F.lit(gram))))).alias("h"))
    taken = runs.select(F.explode(F.array(*_slots(F.col("h"), slots))).alias("slot"))
    parts = dict(taken.groupBy(F.shiftright("slot", 15)).agg(F.bitmap_construct_agg((F.col("slot") % 32768).cast("long"))).collect())
    return b"".join(b"".join(map(_UNPACKED.__getitem__, parts[k])) if k in parts else bytes(32768) for k in range(slots // 32768))


def _candidates(windows: DataFrame, width: int, slots: int) -> Column:
    """Windows of `words` whose run of words at a multiple of the stride passes the map."""
    gram = min(GRAM, width)
    stride = width - gram + 1
    bits, n = F.lit(_map(windows, width, gram, slots)), F.size("words")

    def passes(q: Column) -> Column:
        one, two = _slots(F.xxhash64(F.slice("words", q + 1, F.lit(gram))), slots)
        return (F.substring(bits, one + 1, F.lit(1)) == F.lit(b"\x01")) & (F.substring(bits, two + 1, F.lit(1)) == F.lit(b"\x01"))

    def around(q: Column) -> Column:
        first, last = F.greatest(q - (stride - 1), F.lit(0)), F.least(q, n - width)
        return F.transform(
            F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")),
            lambda p: F.struct(p.alias("p"), F.lit(width).alias("width"), F.array_join(F.slice("words", p + 1, F.lit(width)), " ").alias("window")),
        )

    runs = F.filter(F.when(n >= width, F.sequence(F.lit(0), n - gram, F.lit(stride))).otherwise(F.array().cast("array<int>")), passes)
    return F.flatten(F.transform(runs, around))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = SIZE, max_set: int = MAX_SET) -> DataFrame:
    """(id, fingerprint, copies, n_words, n_hit, item_ids, spans) for each distinct row of id and text.

    spans: the word ranges that are hit, merged: (first word from 0, words).
    """
    windows = materialize(benchmark_windows(benchmark, item_col, "text", size))
    widths = dict(sorted(windows.groupBy("width").count().collect()))  # at most `size` numbers
    inside = sum(widths.values()) <= max_set
    row = F.struct(F.lit(-1).alias("p"), F.lit(0).alias("width"), F.lit(None).cast("string").alias("window"))
    # explode_outer of a single element keeps the optimiser from copying the splitting of the text
    # into the lambdas below, where it would run once for each window
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")))).alias("fingerprint"), F.explode_outer(F.array(word_array(F.col(text_col)))).alias("words")
    )
    # the first element stands for the row itself, so that rows without hits stay and copies are counted
    rows = base.select("id", "fingerprint", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.concat(F.array(row), *[_candidates(windows, w, slots_for(n)) for w, n in widths.items()])).alias("hit"))
    rows = rows.select("id", "fingerprint", "n_words", "hit.*")
    known_windows = windows.select("window", "items")
    joined = rows.join(F.broadcast(known_windows) if inside else known_windows, "window", "left").where("p < 0 or items is not null")
    per = joined.groupBy("id", "fingerprint", "n_words").agg(
        F.sum(F.when(F.col("p") < 0, 1).otherwise(0)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("p") >= 0, F.struct("p", "width")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"),
    )
    # ends grow with the starts but for items of other widths, so a running end is kept
    spans = F.expr(
        """aggregate(hits, cast(array() as array<struct<first: int, words: int>>), (acc, h) -> case
            when size(acc) = 0 or h.p > acc[size(acc) - 1].first + acc[size(acc) - 1].words
              then concat(acc, array(named_struct('first', h.p, 'words', h.width)))
            else concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', acc[size(acc) - 1].first,
              'words', greatest(acc[size(acc) - 1].words, h.p + h.width - acc[size(acc) - 1].first)))) end)"""
    )
    per = per.select("id", "fingerprint", "copies", "n_words", F.array_sort("item_ids").alias("item_ids"), spans.alias("spans"))
    return per.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.words)"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    per = contamination(docs, benchmark, id_col, text_col)
    each = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """`docs` without contaminated documents; or, with `spans`, all of them without the hit words.

    A removed word goes with the separators after it.
    """
    per = contamination(docs, benchmark, id_col, text_col).where("n_hit > 0")
    key = F.xxhash64(F.col(text_col), F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    # the row as one column, so that its names can't clash with ours
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("mine"), key.alias("print"))
    same = F.col("mine").eqNullSafe(F.col("id")) & (F.col("print") == F.col("fingerprint"))
    if not spans:
        return keyed.join(per.where("20 * n_hit >= n_words").select("id", "fingerprint"), same, "left_anti").select("row.*")
    joined = keyed.join(per.select("id", "fingerprint", "spans"), same, "left")
    text = F.col("row")[text_col]
    lead = SEPARATORS[:-1] + "*"
    pieces = F.regexp_extract_all(text, F.lit(f"({SEPARATORS.replace('[', '[^', 1)}{lead})"), F.lit(1))
    kept = F.filter(pieces, lambda w, i: ~F.exists(F.col("spans"), lambda s: (i >= s["first"]) & (i < s["first"] + s["words"])))
    cut = F.concat(F.regexp_extract(text, f"^{lead}", 0), F.array_join(kept, ""))
    return joined.select(*[F.when(F.col("spans").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
