"""Near-duplicate documents by SetSketch registers, banding, likelihood and exact verification.

A document's set of word shingles is summarised by M registers: register i keeps the floor of
-log_B of the least of exponential variates that the elements draw for it, truncated to 16 bits
(SetSketch, base B close to 1). Registers of a union are the maxima of the registers, and equal
registers are about as likely as the Jaccard similarity.

1. Documents with the same set form one class, by a 128-bit digest of the sorted set.
2. Runs of ROWS registers are band keys. Classes that share a key with the least class of that key
   are joined, and the connected components of that candidate graph (linear in the classes) are
   the families within which all links lie. A pair of similarity 0.8 shares no key at all with a
   probability of about 5e-8.
3. Within a family, pairs are judged by a likelihood-ratio test on (register greater, equal, less)
   given both set sizes, then confirmed on the full sets, unless both are connected already. The
   test turns away a pair at the threshold with a chance below 1e-7.
   Families of more than BLOCK classes or BLOCK_BYTES of sets are dealt out as pairs of blocks, so
   that no task holds more than about two blocks, and every pair is still looked at exactly once.
   That is quadratic in the family's blocks, and the price of losing no link.
4. Connected components of the confirmed links; the least document id stands for each.

Cases: null or wordless text has the empty set, is linked with nothing, and is kept. Repeated rows
give repeated results. A null id is never the least while others are there; a document whose
id is null is linked as any other. Where all ids of a component are null, component_id is null and
all its rows are kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, materialize, mix, shingle_hashes, slices, small_batches
from .components import components

M, ROWS = 128, 4
BASE, RATE = 1.001, 20.0
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Twice the log-likelihood ratio above which a pair is held to be below the threshold.
REJECT = 32.0


def registers(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, M) uint16 registers of n sets; element h[k] belongs to set doc[k].

    Each element is the seed of a Poisson process of rate M whose points fall on random registers,
    which gives independent exponential variates in ascending order. An element drops out once its
    next point is past the largest minimum of its set.
    """
    least = np.full(n * M, np.inf)
    state, at, row = h.copy(), np.zeros(len(h)), doc * M
    while len(state):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        z = mix(state)
        at = at - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / M
        slot = (mix(z ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(40)).astype(np.int64) * M >> 24
        np.minimum.at(least, row + slot, at)
        live = at < least.reshape(n, M).max(1)[row // M]
        state, at, row = state[live], at[live], row[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0), 0, 65535).astype(np.uint16).reshape(n, M)


def text_sets(texts: list[bytes | None], memo: WordHashes, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes((t or b"").lower().split(), memo, size)) for t in texts]


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for i, j in slices([len(t or b"") for t in texts], 4 << 20):
            sets = text_sets(texts[i:j], memo, size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            regs = registers(np.concatenate(sets), np.repeat(np.arange(len(full)), n[full]), len(full)) if len(full) else []
            out: list = [None] * (j - i)
            for k, r in zip(full, regs, strict=True):
                out[k] = r.astype(">u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(out, pa.binary())],
                names=["id", "mark", "n", "sig", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(text, sig, ...) -> the set of each text whose digest is sig; other columns go along."""
    memo = WordHashes()
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for i, j in slices([len(t or b"") for t in texts], 4 << 20):
            rest = batch.slice(i, j - i)
            sets = text_sets(texts[i:j], memo, size)
            same = [k for k, (s, d) in enumerate(zip(sets, rest.column(1).to_pylist(), strict=True)) if digest(s) == d]
            rest = rest.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array([sets[k].tobytes() for k in same], pa.binary())], names=["sig", "family", "size", "regs", "shingles"])


def unlikely(more: np.ndarray, same: np.ndarray, less: np.ndarray, nu: float, nv: np.ndarray, least: float) -> np.ndarray:
    """Whether the registers speak against a similarity of `least` or more.

    The likelihood of (more, same, less) under similarity J has cell probabilities
    p(u - v J), 1 - both, p(v - u J), with p(x) = -log_B(1 - x (B-1)/B) and u, v the shares of the
    two set sizes; J is at most the ratio of the sizes.
    """
    u = (nu / (nu + nv))[:, None]
    v = 1 - u
    grid = np.append(np.linspace(0, least, 33), np.linspace(least, 1, 9)[1:])[None, :]
    grid = np.minimum(grid, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return 2 * (like.max(1) - like[:, 32:].max(1)) > REJECT


def _links(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """A spanning set of confirmed links among one block, or between the two blocks of a pair."""
    group = group.sort_values("sig", ignore_index=True)
    sig, size, side = group["sig"].tolist(), group["size"].to_numpy(np.float64), group["side"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    regs = np.stack([np.frombuffer(r, ">u2") for r in group["regs"]]).astype(np.uint16)
    parent = list(range(len(sig)))
    two = len(set(side)) > 1

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(sig) - 1):
        rest = regs[i + 1 :]
        same = (rest == regs[i]).sum(1)
        small, large = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        # sets whose sizes alone forbid the similarity, or far too few equal registers
        may = np.flatnonzero((den * small >= num * large) & (same >= M * num / den / 2) & ((side[i + 1 :] != side[i]) | (not two)))
        if not len(may):
            continue
        more = (rest[may] < regs[i]).sum(1)
        no = unlikely(more, same[may], M - same[may] - more, size[i], size[i + 1 :][may], num / den)
        for j in may[~no] + i + 1:
            if (a := find(i)) == (b := find(j)):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[max(a, b)] = min(a, b)
                out.append((sig[i], sig[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    num, den = threshold
    # the mark of a text finds the rows whose id is null or stands for several texts
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    kind = docs.schema["id"].dataType.simpleString()
    sketched = materialize(docs.mapInArrow(partial(_sketch, size=words), f"id {kind}, mark long, n long, sig binary, regs binary"))
    classes = sketched.where("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("row"), F.first("n").alias("size"), F.first("regs").alias("regs"))
    classes = materialize(classes.select("sig", "row.id", "row.mark", "size", "regs"))
    width = 2 * ROWS
    keyed = classes.select("sig", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(M // ROWS - 1)), lambda k: F.substring("regs", k * width + 1, F.lit(width)))).alias("band", "key"))
    keyed = keyed.select("sig", F.xxhash64("band", "key").alias("key"))
    leaders = materialize(keyed.groupBy("key").agg(F.min("sig").alias("b"), F.count("*").alias("k")).where("k > 1").select("key", "b"))
    grown = components(keyed.join(leaders, "key").select(F.col("sig").alias("a"), "b"))
    family = materialize(grown.select(F.col("node").alias("sig"), F.col("root").alias("family")))
    discard(leaders, grown)
    members = classes.join(family, "sig").withColumnsRenamed({"id": "own", "mark": "own_mark"})
    texts = docs.join(members, (F.col("mark") == F.col("own_mark")) & F.col("id").eqNullSafe(F.col("own"))).select("text", "sig", "family", "size", "regs")
    sets = texts.mapInArrow(partial(_sets, size=words), "sig binary, family binary, size long, regs binary, shingles binary")
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    spread = sets.dropDuplicates(["sig"]).join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    # block x meets every block y >= x once, in the group of that pair
    dealt = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sig", "size", "regs", "shingles", "family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("block").alias("side")
    )

    def linked_pairs(group: pd.DataFrame) -> pd.DataFrame:
        return _links(group, num, den)

    links = dealt.groupBy("family", "lo", "hi").applyInPandas(linked_pairs, "a binary, b binary")
    joined = components(links)
    discard(family)  # with the shuffles of sets
    label = joined.join(classes.select(F.col("sig").alias("node"), "id"), "node").select("node", "root", "id")
    least = label.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = label.join(least, "root").select(F.col("node").alias("sig"), "component_id")
    alone = classes.select("sig", F.col("id").alias("own"))
    # written, so that the join below has a shuffle on both sides and a class of many copies is split
    result = materialize(alone.join(linked, "sig", "left").select("sig", F.coalesce("component_id", "own").alias("component_id")))
    discard(joined, classes)
    return sketched.select("id", "n", "sig").join(result, "sig", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), (F.col("id").eqNullSafe(F.coalesce("component_id", "id"))).alias("kept")
    )
