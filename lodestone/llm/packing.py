"""Best-fit packing of tokenised documents into fixed sequences by minimum bin slack.

Only documents longer than a sequence are cut; all but their first piece fill sequences of their
own, which are numbered below zero without any shuffle. What is left are pieces of fewer than SIZE
tokens, of which only the histogram of lengths matters: fewer than SIZE counts, whatever the corpus.
For each bin, subset-sum dynamic programming on a bitset over the available lengths, longest first,
finds the fullest combination that still can be made, which is then removed as many times as the
counts allow at once. The rows are dealt to the bins by their rank among the pieces of equal length;
ranks are counted over cells of about CELL rows first, dealt by a number of their own, so that no
task holds all pieces of a length.

Cases: a null or empty text is the end token alone. Repeated rows are packed each. A null id is a
value like others. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

SIZE, END = 1024, 2
#: Rows of a cell of ranks; cells whose counts may be broadcast.
CELL, MAX_CELLS = 50_000, 200_000
VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str):
    """text -> ids as the JSON tokenizer gives them without added special tokens.

    The rank file holds the same vocabulary for a faster encoder with equal ids. Texts that spell
    out a special token go to the JSON tokenizer, which knows it.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(json_path) as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    whole = Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _tokenize(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], size: int, end: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(*paths)
    for batch in batches:
        ids, rows, seen = batch.column(0), [], {}
        for i, text in enumerate(batch.column(1).to_pylist()):
            text = text or ""
            found = seen.get(text)
            if found is None:
                tokens = np.array([*encode(text), end], dtype="<u4")
                found = seen[text] = [(k, s, n, zlib.crc32(tokens[s : s + n].tobytes())) for k, (s, n) in enumerate(pieces(len(tokens), size))]
            rows += [(i, *x) for x in found]
        at, piece, start, length, crc = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"]
        )


def fill(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times): each time the fullest combination of what is left.

    reach[k] is the bitset of the sums of the first k lengths; walking back from the fullest sum
    gives the combination. The longest piece left is always taken, so that each bin holds it.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    mask = (1 << (size + 1)) - 1
    while left:
        lengths = sorted(left, reverse=True)
        head, room = lengths[0], size - lengths[0]
        left[head] -= 1
        items = [(n, min(left[n], room // n)) for n in lengths if n <= room and left[n]]
        reach, steps = [1], []
        for n, most in items:
            now, take = reach[-1], 1
            while most > 0:  # powers of two of a length stand for all its multiples
                take_now = min(take, most)
                now |= (now << (n * take_now)) & ((1 << (room + 1)) - 1) & mask
                steps.append((n, take_now))
                reach.append(now)
                most -= take_now
                take *= 2
            if now >> room & 1:
                break
        left[head] += 1
        total, chosen = reach[-1].bit_length() - 1, [head]
        for k in range(len(steps) - 1, -1, -1):
            if not reach[k] >> total & 1:
                n, times = steps[k]
                chosen += [n] * times
                total -= n * times
        used: dict[int, int] = defaultdict(int)
        for n in chosen:
            used[n] += 1
        times = min(left[n] // k for n, k in used.items())
        out.append((chosen, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]]:
    """For each length: the ranks at which its runs begin, and (rank, first bin, offsets) of them."""
    runs: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for lengths, times in bins:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for n in lengths:
            offsets[n].append(at)
            at += n
        for n, where in offsets.items():
            runs[n].append((taken[n], first, where))
            taken[n] += len(where) * times
        first += times
    return {n: ([r[0] for r in x], x) for n, x in runs.items()}


def _deal(batches: Iterator[pd.DataFrame], places: dict) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sequence, offset = [], []
        for n, rank in zip(batch["length"].tolist(), batch["rank"].tolist(), strict=True):
            starts, runs = places[n]
            begin, first, where = runs[bisect_right(starts, rank) - 1]
            sequence.append(first + (rank - begin) // len(where))
            offset.append(where[(rank - begin) % len(where)])
        yield batch.drop(columns="rank").assign(sequence_id=np.array(sequence, np.int64), offset=np.array(offset, np.int64))


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, paths: tuple[str, str] | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    paths = paths or (vocabulary_path(f"{VOCABULARY}.json"), vocabulary_path(f"{VOCABULARY}.tiktoken"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_tokenize, paths=paths, size=size, end=end), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    cut = materialize(tokenized_pieces(docs, id_col, text_col, size, end, paths).withColumn("n", F.monotonically_increasing_id()))
    kept = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == size).select(*kept, (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < size)
    counts = {n: c for n, c in rest.groupBy("length").count().collect()}  # fewer than `size` numbers
    salts = {n: -(-c // CELL) for n, c in counts.items()}
    # length n is dealt to salts[n] cells; lengths are small, so an array holds them
    of = F.get(F.array(*[F.lit(salts.get(n, 1)) for n in range(size)]), F.col("length").cast("int"))
    salted = rest.withColumn("salt", F.pmod("n", of))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("k"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if sum(salts.values()) <= MAX_CELLS else offsets
    within = Window.partitionBy("length", "salt").orderBy("n")
    ranked = salted.withColumn("at", F.row_number().over(within)).join(offsets, ["length", "salt"])
    ranked = ranked.select(*kept, (F.col("before") + F.col("at") - 1).alias("rank"))
    kind = ranked.schema[id_col].dataType.simpleString()
    dealt = ranked.mapInPandas(partial(_deal, places=_places(fill(counts, size))), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(dealt)
