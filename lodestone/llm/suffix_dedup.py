"""Removal of bytes that lie in a WIDTH-byte string standing anywhere else in the corpus.

Equal windows are found exactly in three steps of falling volume:

1. Each text is cut into runs of windows with a common anchor (see anchors.py), about one run for
   70 bytes. A window can only stand elsewhere if its anchor does, so other runs are done.
2. Runs with equal anchors and equal bytes repeat as a whole.
3. What is left are anchors with several different fragments, some percent of the bytes. Fragments
   of an anchor are aligned on it, and a Burrows-Wheeler transform of the aligned collection is
   built column by column: each round inserts one symbol of every fragment, and updates the order
   of the fragments by reversed context (the positional transform) and the array of common
   lengths between neighbours. A window is repeated just if its common length with a neighbour
   reaches WIDTH when its last symbol is inserted. Groups stream through a task in the order of a
   sorted file, at most BATCH fragments at once.

The transform of whole texts, one symbol a round, would need as many passes over a file of the
corpus as the longest text has bytes, so only short aligned fragments are treated in that way.

Fragments that hold their anchor's string more than once (periodic texts) have no single
alignment, and anchors with more than HOT fragments no bounded group: for those, the distinct
windows of each fragment are hashed (128 bits) and counted by an aggregation.

Cases: a null text is empty; texts of fewer than WIDTH bytes keep all. Repeated rows remove each
other, as each stands elsewhere. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import GRAMS, WIDTH, Runs, window_hashes
from .common import discard, materialize, slices, small_batches

HOT = 50_000
BATCH = 20_000
#: Bytes that are cut into runs at once.
CHUNK = 1 << 19
_COLUMNS = 2 * (GRAMS - 1) + WIDTH - GRAMS + 1
_ABSENT = 256


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        for i, j in slices([len(t) for t in texts], CHUNK):
            r = Runs(texts[i:j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.anchor.view(np.int64)), pa.array(keys[i:j][r.text]), pa.array(lows[i:j][r.text]), pa.array(r.first.astype(np.int32)), pa.array(r.count.astype(np.int32)), pa.array(r.fragment.view(np.int64)),
                 pa.array(np.where(r.ties > 1, -1, r.at).astype(np.int32))], names=["anchor", "key", "low", "first", "count", "fragment", "at"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, runs) -> the bytes of each run."""
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(r["anchor"], r["fragment"], r["at"], r["loose"], text[r["first"] : r["first"] + r["count"] + WIDTH - 1]) for r in runs]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()], strict=True)], names=["anchor", "fragment", "at", "loose", "body"])


def repeated_windows(group: np.ndarray, at: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Which windows stand in another fragment of their group as well: bool (fragments, GRAMS).

    `group` ascends; fragment i has its anchor at `at[i]`, so that its first symbol is in column
    GRAMS - 1 - at[i]. Window w of a row begins in column w.
    """
    n = len(bodies)
    symbols = np.full((n, _COLUMNS), _ABSENT, np.int16)
    for row, a, body in zip(symbols, at.tolist(), bodies, strict=True):
        lead = GRAMS - 1 - a
        row[lead : lead + len(body)] = np.frombuffer(body, np.uint8)
    symbols = np.ascontiguousarray(symbols.T)
    found = np.zeros((n, GRAMS), bool)
    base = group.astype(np.int64) * (_ABSENT + 1)
    order, since = np.arange(n), np.zeros(n + 1, np.int32)
    since[0] = _COLUMNS
    since[1:n] = np.where(group[1:] != group[:-1], _COLUMNS, 0)
    for k in range(_COLUMNS):
        symbol = symbols[k][order]
        key = base[order] + symbol
        turned = np.argsort(key, kind="stable")
        key = key[turned]
        now = np.full(n + 1, k + 1, np.int32)
        # equal symbols: they agree since the latest start between their former places
        joined = np.flatnonzero((key[1:] == key[:-1]) & (symbol[turned[1:]] != _ABSENT))
        if len(joined):
            latest = np.maximum.reduceat(since, turned + 1)
            now[joined + 1] = latest[joined]
        order, since = order[turned], now
        if k >= WIDTH - 1:
            hit = np.flatnonzero(k + 1 - since[1:n] >= WIDTH) + 1
            found[order[hit], k - WIDTH + 1] = True
            found[order[hit - 1], k - WIDTH + 1] = True
    return found


def _spans(row: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments sorted by anchor -> the repeated windows of each, as spans."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        anchors, at = part["anchor"].to_numpy(), part["at"].to_numpy()
        group = np.cumsum(np.append(0, anchors[1:] != anchors[:-1]))
        found = repeated_windows(group, at, part["body"].tolist())
        spans = [_spans(row[GRAMS - 1 - a :]) if row.any() else None for row, a in zip(found, at.tolist(), strict=True)]
        out = part[["anchor", "fragment"]].assign(spans=spans)
        return out[out["spans"].notna()]

    held: pd.DataFrame | None = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) >= BATCH:
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(held["anchor"].to_numpy(), held["anchor"].iloc[-1]))
            if cut:
                yield solve(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield solve(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of loose fragments: hashes, how often here, and where.

    A window that stands twice in its fragment is repeated whatever else there is, and only one
    row with all such places is made for it; the row of its hashes has no place. So a periodic
    fragment makes as many rows as its period has bytes.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    names = ["anchor", "fragment", "one", "two", "n", "spans"]
    for batch in batches:
        held: list[list] = [[] for _ in names]
        for anchor, fragment, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, two = window_hashes(body, 1), window_hashes(body, 2)
            _, first, inverse, count = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
            spans = [[{"start": int(f), "stop": int(f) + 1}] if c == 1 else [] for f, c in zip(first, count, strict=True)]
            n = len(first)
            columns = [[anchor] * (n + 1), [fragment] * (n + 1), [*one[first].view(np.int64).tolist(), None], [*two[first].view(np.int64).tolist(), None], [*count.tolist(), 0], [*spans, _spans(count[inverse] > 1)]]
            for all_, some in zip(held, columns, strict=True):
                all_ += some
            if len(held[0]) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)
                held = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, as two numbers."""
    return [F.xxhash64(id_col, text_col).alias("key"), F.xxhash64(F.lit(7), text_col, id_col).alias("low")]


_SPANS = "array<struct<start: int, stop: int>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, low, spans): for each row key with repeated windows, the ranges of their first bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    runs = materialize(rows.mapInArrow(_runs, "anchor long, key long, low long, first int, count int, fragment long, at int"))
    many = runs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("fragment") != F.max("fragment")).alias("several"), (F.min("at") < 0).alias("periodic"))
    many = materialize(many.where("n > 1 or periodic").drop("n"))
    again = materialize(runs.join(many, "anchor"))
    discard(runs, many)
    pieces = again.groupBy("anchor", "fragment").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "low", "first", "count", "at")).alias("one"), F.first("several").alias("several"), F.first("periodic").alias("periodic"), F.max("count").alias("count")
    )
    pieces = materialize(pieces)
    open_ = pieces.where("several or periodic")
    # written, so that the join with it has a shuffle on both sides and hot anchors are split
    hot = materialize(open_.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("anchor", F.lit(True).alias("hot")))
    wanted = open_.join(hot, "anchor", "left").select("anchor", "fragment", "one.*", (F.col("periodic") | F.coalesce("hot", F.lit(False))).alias("loose"))
    wanted = wanted.groupBy("key", "low").agg(F.collect_list(F.struct("anchor", "fragment", "first", "count", "at", "loose")).alias("runs"))
    bodies = rows.join(wanted, ["key", "low"]).select("text", "runs").mapInArrow(_cut, "anchor long, fragment long, at int, loose boolean, body binary")
    bodies = materialize(bodies)
    discard(hot)
    firm = bodies.where("not loose").dropDuplicates(["anchor", "fragment"]).repartition("anchor").sortWithinPartitions("anchor", "fragment")
    solved = firm.select("anchor", "fragment", "at", "body").mapInPandas(_transform, f"anchor long, fragment long, spans {_SPANS}")
    # few bytes that make many rows: dealt out by number, so that they are not put together again
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    loose = bodies.where("loose").dropDuplicates(["anchor", "fragment"]).select("anchor", "fragment", "body").repartition(wide, "fragment")
    loose = materialize(loose.mapInArrow(_windows, f"anchor long, fragment long, one long, two long, n int, spans {_SPANS}"))
    single = loose.where("n = 1")
    twice = loose.where("n > 0").groupBy("one", "two").agg(F.sum("n").alias("k")).where("k > 1").select("one", "two")
    counted = single.join(twice, ["one", "two"]).select("anchor", "fragment", F.explode("spans").alias("s")).unionByName(loose.where("n = 0").select("anchor", "fragment", F.explode("spans").alias("s")))
    counted = counted.groupBy("anchor", "fragment").agg(F.collect_list("s").alias("spans"))
    whole = pieces.where("n > 1").select("anchor", "fragment", F.array(F.struct(F.lit(0).alias("start"), F.col("count").alias("stop"))).alias("spans"))
    spans = materialize(whole.unionByName(solved).unionByName(counted))
    discard(bodies, loose, pieces)
    each = again.join(spans, ["anchor", "fragment"]).select("key", "low", F.explode("spans").alias("s"), "first")
    found = each.groupBy("key", "low").agg(F.array_sort(F.collect_set(F.struct((F.col("first") + F.col("s.start")).alias("start"), (F.col("first") + F.col("s.stop")).alias("stop")))).alias("spans"))
    found = materialize(found)
    discard(again, spans)
    return found


def keep_bytes(raw: bytes, spans: list[dict[str, int]]) -> tuple[bytes, int, int]:
    """(what is kept, bytes removed, runs removed) for sorted ranges of window starts."""
    kept, at, removed, n = [], 0, 0, 0
    stop = None
    for s in spans:
        a, b = s["start"], s["stop"] + WIDTH - 1
        if stop is None or a > stop:
            kept.append(raw[at:a])
            n += 1
            removed += b - a
            stop = b
        elif b > stop:
            removed += b - stop
            stop = b
        at = stop
    kept.append(raw[at:])
    return b"".join(kept), removed, n


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, removed, n = keep_bytes(raw or b"", spans or [])
            out.append((len(raw or b""), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if raw is not None else None))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) for each row of `docs`.

    kept_text is what remains, without characters of which only a part remains. `key_col` tells rows
    apart together with the text where the id column is of a type that can't be hashed; the id by default.
    """
    key_col = key_col or id_col
    spans = repeated_spans(docs, key_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_key(key_col, text_col)).join(spans, ["key", "low"], "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_report, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
