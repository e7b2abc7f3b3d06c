"""Whitening of embeddings: streaming covariance, symmetric QR, projections of unit variance.

The fit list holds each distinct integer vector once. Each task walks its share of it and updates
count, mean and scatter by Welford's rank-one step, so that differences are taken before products;
shares are merged by the parallel update formula, in groups of bounded size and as many rounds as
there are shares, the last one on the driver, which never holds more than MERGE_BYTES of them. The
covariance (dimensions squared, whatever the rows) is turned into tridiagonal form by reflections and
solved by implicit QR steps with Wilkinson's shift. The covariance of the projected fit list is
measured in a second pass, not derived.

Cases: vectors that are null or hold null or non-finite entries are dropped, as are those of an
uncommon length and those with entries of 2^40 and more. Repeated ids and vectors keep their rows,
though a vector is fitted once. Components without variance (of constant or dependent dimensions)
can't be whitened and have no rows; so a fit list of one vector gives an empty result, as does an
empty table. `deviation` is null where it doesn't fit 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import matrix, usable

#: x = floor(SCALE * entry) + OFFSET; entries from which rows are dropped.
SCALE, OFFSET, BELOW = 64, 1_000_000, 2.0**40
#: Bytes of shares that meet in one place; rows of one output batch.
MERGE_BYTES, OUT_ROWS = 64 << 20, 4096


@dataclass
class Moments:
    """Count, mean and scatter (sum of outer products of centred vectors) of a stream of vectors, and their exact sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)), [0] * width)

    def add(self, rows: np.ndarray) -> None:
        """Welford's step for each row: the outer product of its distances to the mean before and after it."""
        step = np.empty_like(self.scatter)
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply.outer(before, x - self.mean, out=step)
            self.scatter += step

    def merge(self, other: Moments) -> None:
        """The moments of both streams together."""
        if not other.n:
            return
        total, apart = self.n + other.n, other.mean - self.mean
        self.scatter += other.scatter + np.multiply.outer(apart, apart) * (self.n * other.n / total)
        self.mean = self.mean + apart * (other.n / total)
        self.n, self.sums = total, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, share: int) -> dict:
        return {"share": share, "n": self.n, "mean": self.mean.tolist(), "scatter": self.scatter.ravel().tolist(), "sums": [Decimal(s) for s in self.sums]}

    @classmethod
    def of(cls, r: dict, width: int) -> Moments:
        return cls(int(r["n"]), np.array(r["mean"], dtype=np.float64), np.array(r["scatter"], dtype=np.float64).reshape(width, width), [int(s) for s in r["sums"]])


SHARES = "share int, n long, mean array<double>, scatter array<double>, sums array<decimal(38,0)>"
_SHARES = pa.schema([("share", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64())), ("sums", pa.list_(pa.decimal128(38, 0)))])


def moments(rows: DataFrame, length: int, width: int, project: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """Of the integer vectors `v` (without OFFSET), or of what `project` makes of a batch of them."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Moments.empty(width)
        for batch in batches:
            x = matrix(batch.column("v"), length)
            seen.add(project(x) if project else x.astype(np.float64))
            if not project:  # rows of a batch times 2^46 stay within 64 bits
                seen.sums = [a + b for a, b in zip(seen.sums, x.sum(axis=0).tolist(), strict=True)]
        if seen.n:
            yield pa.RecordBatch.from_pylist([seen.row(TaskContext.get().partitionId())], schema=_SHARES)

    def merged(shares: pd.DataFrame) -> pd.DataFrame:
        total = Moments.empty(width)
        for r in shares.sort_values("share").to_dict("records"):
            total.merge(Moments.of(r, width))
        return pd.DataFrame([total.row(int(shares["share"].min()) // fan)])

    fan = max(2, min(64, MERGE_BYTES // (8 * width * width + 1)))
    shares = materialize(rows.select("v").mapInArrow(walk, SHARES))
    while shares.count() > fan:
        fewer = materialize(shares.groupBy(F.expr(f"share div {fan}")).applyInPandas(merged, SHARES))
        discard(shares, shuffles=False)
        shares = fewer
    total = Moments.empty(width)
    for r in sorted(shares.collect(), key=lambda r: r["share"]):  # at most `fan` rows
        total.merge(Moments.of(r.asDict(), width))
    discard(shares, shuffles=False)
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, Q') with a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    turned = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        turned[k + 1 :] -= 2 * np.outer(v, v @ turned[k + 1 :])
    return a.diagonal().copy(), a.diagonal(-1).copy(), turned


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows: implicit QR with Wilkinson's shift."""
    d, e, turned = tridiagonal(a)
    tiny, end = np.finfo(np.float64).eps, len(d) - 1
    while end > 0:
        e[np.abs(e) <= tiny * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[end - 1] == 0:
            end -= 1
            continue
        start = end - 1
        while start > 0 and e[start - 1] != 0:
            start -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + math.copysign(math.hypot(half, e[end - 1]), half))
        bulge, beside = d[start] - shift, e[start]
        for k in range(start, end):
            size = math.hypot(bulge, beside)
            c, s = (bulge / size, -beside / size) if size else (1.0, 0.0)
            if k > start:
                e[k - 1] = size
            one, two, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * one - 2 * c * s * off + s * s * two, s * s * one + 2 * c * s * off + c * c * two
            e[k] = c * s * (one - two) + (c * c - s * s) * off
            if k + 1 < end:
                bulge, beside = e[k], -s * e[k + 1]
                e[k + 1] *= c
            turned[k], turned[k + 1] = c * turned[k] - s * turned[k + 1], s * turned[k] + c * turned[k + 1]
    order = np.argsort(-d, kind="stable")
    return d[order], turned[order]


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of `df` and component."""
    rows, length = usable(df, vector_col, BELOW, id=id_col)
    # OFFSET cancels out of every result, so x is kept without it
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    fit = materialize(rows.select("v").distinct())
    all_of = moments(fit, length, length)
    n, sums = all_of.n, all_of.sums
    values, vectors = eigen(all_of.scatter / n) if n else (np.empty(0), np.empty((0, length)))
    least = values[0] * length * np.finfo(np.float64).eps * 4 if len(values) else 0
    kept = min(components, int((values > max(least, 0)).sum()))
    out = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not kept:
        discard(fit, shuffles=False)
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    explained = values[:kept] / all_of.scatter.trace() * n
    scaled = (vectors[:kept] / np.sqrt(values[:kept])[:, None]).T
    peak = max(map(abs, sums), default=0)

    def centred(x: np.ndarray) -> np.ndarray:
        """n times the distance to the mean, exact."""
        if (n * int(np.abs(x).max(initial=0)) + peak) ** 2 * length >= 2**63:
            x = x.astype(object)
        return n * x - np.array(sums, dtype=x.dtype)

    def project(x: np.ndarray) -> np.ndarray:
        return (centred(x) / n).astype(np.float64) @ scaled

    seen = moments(fit, length, kept, project)
    error = float(np.abs(seen.scatter / n - np.eye(kept)).max())
    discard(fit, shuffles=False)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                k, apart = batch.num_rows, centred(matrix(batch.column("v"), length))
                deviation = [s if s < 2**63 else None for s in (apart * apart).sum(axis=1).tolist()]
                each = np.repeat(np.arange(k), kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), k)), pa.array(np.full(k * kept, n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                        pa.array(((apart / n).astype(np.float64) @ scaled).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * kept, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(results, out).withColumnRenamed("id", id_col)
