"""Codes of vectors by codebooks of integer means, with a vector-approximation filter for the nearest entry.

Vectors become integers and are cut into equal parts; each part position has a codebook. A round
assigns every part to the nearest entry and replaces each entry by the floor of its parts' mean.
Rounds are jobs over the whole table: tasks add up counts and sums for each entry, Spark adds these,
and the driver gets the codebooks alone (parts x entries x width numbers, whatever the rows).

The nearest entry is found by filtering: each coordinate of the entries is kept as a cell number of
BITS bits. For a part, one table holds the least and the greatest squared distance to every cell of
every dimension; sums over the dimensions bound the distance to each entry from below and above.
Entries whose lower bound is above the least upper bound are out; the others get their exact integer
distance. All bounds are integers, so the filter never loses the nearest entry, or a tie.

Cases: vectors that are null or hold null or non-finite components are dropped, as are those of an
uncommon length and those with components of 2^41 and more, whose integers doubles can't hold. A
length that the parts don't divide is filled up with zeros. Repeated ids are rows of their own; the
first codebook takes ids in order, null ids last, rows of one id by their vectors. With fewer rows
than entries the codebooks are shorter. Sums of errors beyond 64 bits are null. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, usable

#: Bits of a cell number; what vectors are multiplied by; components from which rows are dropped.
BITS, SCALE, BELOW = 4, 4096, 2.0**41


class CellFilter:
    """Entries of one codebook behind their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        least, most = entries.min(axis=0), entries.max(axis=0)
        width = (most - least) // 2**bits + 1
        self.cell = ((entries - least) // width).astype(np.int64)
        self.low = least + width * np.arange(2**bits)[:, None]
        self.high = self.low + width - 1
        self.refined = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query, of equal ones the first, and the squared distance."""
        under, over = self.low - queries[:, None, :], queries[:, None, :] - self.high
        closest, farthest = np.maximum(np.maximum(under, over), 0), np.maximum(np.abs(under), np.abs(over))
        at = self.cell, np.arange(self.cell.shape[1])
        lower, upper = ((table * table)[:, at[0], at[1]].sum(axis=2) for table in (closest, farthest))
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        self.refined += len(row)
        apart = queries[row] - self.entries[entry]
        exact = (apart * apart).sum(axis=1)
        distances = np.full(lower.shape, exact.max(initial=0) + 1, dtype=queries.dtype)
        distances[row, entry] = exact
        best = distances.argmin(axis=1)
        return best, distances[np.arange(len(best)), best]


def integers(values: np.ndarray, parts: int, peak: int = 0) -> np.ndarray:
    """(rows, parts, width): floors of SCALE times the values; plain Python integers where 64 bits could overflow in distances."""
    floors = np.floor(values * SCALE)
    width = -(-values.shape[1] // parts)
    filled = np.zeros((len(floors), parts * width))
    filled[:, : values.shape[1]] = floors
    most = max(int(np.abs(filled).max(initial=0)), peak)
    whole = filled.astype(np.int64)
    if parts * width * (4 * most + 4) ** 2 >= 2**63:
        whole = whole.astype(object)
    return whole.reshape(-1, parts, width)


def _filters(books: list[list[list[int]]], like: np.dtype) -> list[CellFilter]:
    return [CellFilter(np.array(book, dtype=like)) for book in books]


def _peak(books: list[list[list[int]]]) -> int:
    return max((abs(x) for book in books for entry in book for x in entry), default=0)


def _parts(batches: Iterator[pa.RecordBatch], books: list, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[CellFilter]]]:
    made: dict[np.dtype, list[CellFilter]] = {}
    for batch in batches:
        if batch.num_rows:
            x = integers(matrix(batch.column("v"), length), len(books), _peak(books))
            if x.dtype not in made:
                made[x.dtype] = _filters(books, x.dtype)
            yield batch, x, made[x.dtype]


def improved(rows: DataFrame, books: list[list[list[int]]], length: int) -> list[list[list[int]]]:
    """The codebooks after one round; an entry that no part chose stays."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((len(books), len(books[0])), np.int64), None
        for _, x, filters in _parts(batches, books, length):
            if total is None:
                total = np.zeros((*count.shape, x.shape[2]), object)
            for p, cells in enumerate(filters):
                best, _ = cells.nearest(x[:, p])
                count[p] += np.bincount(best, minlength=count.shape[1])
                for e in np.unique(best):
                    total[p, e] += x[best == e, p].sum(axis=0)
        found = [{"part": p, "entry": e, "n": count[p, e], "sums": [Decimal(int(s)) for s in total[p, e]]} for p, e in zip(*np.nonzero(count), strict=True)]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    sums = rows.select("v").mapInArrow(totals, "part int, entry int, n long, sums array<decimal(38,0)>").select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
    after = [[list(entry) for entry in book] for book in books]
    for r in sums.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # a row for each number in the codebooks
        after[r["part"]][r["entry"]][r["pos"]] = int(r["s"]) // r["n"]
    return after


def encode(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each usable row of `df`."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries, and a part at least")
    rows, length = usable(df, vector_col, BELOW, id=id_col, label=label_col)
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    if not first:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    seeds = integers(np.array(first, dtype=np.float64).reshape(len(first), length), parts)
    books = [[[int(c) for c in entry] for entry in seeds[:, p]] for p in range(parts)]
    for _ in range(rounds):
        after = improved(rows, books, length)
        if after == books:  # further rounds would change nothing
            break
        books = after
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, filters in _parts(batches, books, length):
            found = [cells.nearest(x[:, p]) for p, cells in enumerate(filters)]
            code = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            said = [int(e) if e < 2**63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(said, pa.int64())], names=["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = materialize(rows.mapInArrow(codes, f"id {types['id']}, label {types['label']}, code string, error long"))
    whole = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    sums = coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "its")
    # as long as labels are few, their sums are broadcast by their measured size; else a hot label is split
    return coded.join(sums, F.col("label").eqNullSafe(F.col("its"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
