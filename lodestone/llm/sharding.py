"""Contiguous minimax sharding of atomic groups (equal texts), with DataFrame functions only.

Groups are ordered by the MD5 of their text, and all of them are cut in that order. A shard is a run
of groups within the capacity, or one group alone where that is larger than the capacity, as it can't
be divided. The smallest capacity is sought with which a greedy walk needs no more than the wanted
shards, and the order is cut where that walk cuts. So the largest shard is as small as any contiguous
partition can have it, and one huge group doesn't let the other shards grow to its size.

The walk runs on the driver over a histogram by MD5 prefix, of at most 65,536 sums; only buckets in
which a cut may lie are split by one more digit, until each holds a single group, so what the driver
holds doesn't grow with the rows and the result is exact.

Places within a shard are numbered in two steps: rows are dealt to cells of about CELL rows by a
number of their own, whatever their values; cells are numbered by their counts, rows within their
cell; so no task holds a shard.

Cases: a null text is an empty one, of `overhead` bytes, and groups with it. Repeated rows have
places of their own. A null id is a value like others. Extra columns are ignored. With fewer
groups than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FIRST_DIGITS = 4
#: Rows of a cell of places; cells whose counts may be broadcast.
CELL, MAX_CELLS = 50_000, 200_000


class _Order:
    """Ordered buckets (prefix, bytes, groups, bytes of the largest group) and the walk over them."""

    def __init__(self, items: list[tuple[str, int, int, int]]):
        self.items = sorted(items)
        self.ends = [0, *accumulate(x[1] for x in self.items)]

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the position (bytes before it) of each cut of the greedy walk."""
        ends, items, n = self.ends, self.items, len(self.items)
        lo = hi = 0
        cuts = []
        for _ in range(shards):
            i = bisect_right(ends, lo) - 1  # lo is always the start of a bucket
            j = bisect_right(ends, lo + capacity) - 1  # whole buckets surely fit up to here
            lo = ends[i + 1] if i == j < n and items[i][2] == 1 else ends[j]
            i = bisect_right(ends, hi) - 1
            j = bisect_right(ends, hi + capacity) - 1
            far = ends[j] if j == n or items[j][2] == 1 else hi + capacity
            # the shard may also be one large group of the bucket that it begins in
            hi = max(far, min(ends[i + 1], hi + items[i][3])) if i < n and (items[i][2] > 1 or hi == ends[i]) else far
            cuts.append((lo, hi))
        return cuts

    def least(self, shards: int, sure: bool) -> int:
        """Smallest capacity whose walk surely (or possibly) reaches the end."""
        total = self.ends[-1]
        low, high = 1, total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards)[-1][0 if sure else 1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[str]:
        """Prefixes of the buckets, of several groups each, in which a cut may lie."""
        found: set[str] = set()
        if low == high and all(a == b for a, b in self.walk(low, shards)):
            return []
        for (a, _), (_, b) in zip(self.walk(low, shards), self.walk(high, shards), strict=True):
            for i in range(bisect_right(self.ends, a) - 1, min(bisect_right(self.ends, b), len(self.items))):
                if self.items[i][2] > 1:
                    found.add(self.items[i][0])
        return sorted(found)


def _even_cuts(groups: DataFrame, shards: int) -> list[str]:
    """The prefix with which each shard but the first begins."""

    def histogram(of: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        return [tuple(r) for r in of.groupBy(F.substring("grp", 1, digits).alias("prefix")).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()]

    digits = FIRST_DIGITS
    order = _Order(histogram(groups, digits))
    while order.items:
        low, high = order.least(shards, sure=False), order.least(shards, sure=True)
        split = order.unsure(low, high, shards)
        if not split:
            break
        wanted = groups.sparkSession.createDataFrame([(p,) for p in split], "prefix string")
        part = groups.join(F.broadcast(wanted), F.substring("grp", 1, digits) == F.col("prefix"), "left_semi")
        digits += 1
        gone = set(split)
        order = _Order([x for x in order.items if x[0] not in gone] + histogram(part, digits))
    if not order.items:
        return []
    cuts = order.walk(order.least(shards, sure=True), shards)
    starts = [bisect_right(order.ends, at) - 1 for at, _ in cuts[:-1]]
    return [order.items[i][0] for i in starts if i < len(order.items)]


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp"), F.monotonically_increasing_id().alias("n")))
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    cuts = _even_cuts(groups, shards)
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: c <= F.col("grp")))
    salts = -(-rows.count() // (CELL * shards)) + 16
    placed = rows.select("*", shard.cast("int").alias("shard"), F.pmod("n", F.lit(salts)).alias("salt"))
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    counts = F.broadcast(counts) if salts * shards <= MAX_CELLS else counts
    within = Window.partitionBy("shard", "salt").orderBy("n")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(counts, ["shard", "salt"])
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
        )
    )
