"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words and their beginnings of four and five bytes (which tie
inflected forms together), hashed to SLOTS. The model takes the COLUMNS slots that tell the labels apart best
alone (by chi squared), and without a limit the slots of every pair that tells them apart only
jointly, so that pure interactions enter, too. Besides a weight, each has FACTORS numbers, and the inner products of
two features' numbers score their joint presence, which additive weights miss. It is fitted on the
driver on at most MAX_FIT labelled rows, the first by a hash of the id, and sent to the tasks as
two small tables.

Cases: null and empty texts have no features and score the model's bias, the rate among texts without any term. Without labels the score is
one half everywhere. Labels that are null are left out; of several labels of one id the largest counts. Very long texts are read whole.
Repeated rows give repeated results. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SLOTS = 1 << 20
COLUMNS = 2048
FACTORS = 8
#: A slot enters the model alone from this chi squared (one in a thousand by chance).
CHI = 10.83
#: Pairs are tested among slots in this share of the fitted rows or more; from this many standard errors on, both enter the model.
PAIR_SHARE, PAIR_Z, PAIR_BLOCK = 0.01, 6.5, 512
MAX_FIT = 12_000
EPOCHS, STEPS, BATCH, RATE, DECAY = 10, 1000, 128, 0.05, 1e-4

#: A-Z to a-z; ASCII characters other than letters and digits to spaces.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_CLEAN).split())


def slots_of(word: bytes) -> list[int]:
    """The slots of a word and of its beginnings."""
    forms = [b"w" + word, *(b"p" + word[:n] for n in (4, 5) if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) % SLOTS for x in forms]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(np.array([s for w in terms(t) for s in slots_of(w)], np.int32)).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "slots"])


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group."""
    return np.stack([np.bincount(group, column, n) for column in values.T], axis=1)


class Model:
    def __init__(self, columns: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.columns, self.bias, self.weights, self.factors = columns, bias, weights, factors

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities for rows of column numbers."""
        n = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        if n.sum():
            flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
            out += np.bincount(row, self.weights[flat], len(rows))
            v = self.factors[flat]
            sums = _sums(v, row, len(rows))
            out += 0.5 * ((sums**2).sum(1) - np.bincount(row, (v**2).sum(1), len(rows)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def interacting(rows: list[np.ndarray], labels: np.ndarray, candidates: np.ndarray, least: float = PAIR_Z) -> np.ndarray:
    """The candidates that have a partner with which they tell the labels apart other than each alone does.

    For every two candidates, the rows with both, one, the other and none give four log odds of the
    label; their contrast, over its standard error, is `least` or more for such a pair. Counts of
    pairs come from products of blocks of the 0/1 matrix, so all pairs are counted.
    """
    k, n, pos = len(candidates), len(rows), int(labels.sum())
    index = np.full(SLOTS, -1, np.int32)
    index[candidates] = np.arange(k)
    held = [c[c >= 0] for c in (index[r] for r in rows)]
    cells = np.concatenate(held).astype(np.int64) * n + np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in held])
    del held
    cells.sort()  # by column, then by row
    total = np.bincount(cells // n, minlength=k).astype(np.float32)
    toxic = np.bincount((cells // n)[labels[cells % n] == 1], minlength=k).astype(np.float32)

    def block(at: int) -> np.ndarray:
        part = cells[slice(*np.searchsorted(cells, [at * n, (at + PAIR_BLOCK) * n]))]
        out = np.zeros((n, min(PAIR_BLOCK, k - at)), np.float32)
        out[part % n, part // n - at] = 1
        return out

    odds = lambda both, bad: (np.log((bad + 0.5) / (both - bad + 0.5)), 1 / (bad + 0.5) + 1 / (both - bad + 0.5))
    best = np.zeros(k, np.float32)
    yes = labels == 1
    for i in range(0, k, PAIR_BLOCK):
        left = block(i)
        for j in range(i, k, PAIR_BLOCK):
            right = left if i == j else block(j)
            both, bad = left.T @ right, left[yes].T @ right[yes]
            ti, xi, tj, xj = (x[at : at + PAIR_BLOCK] for at in (i, j) for x in (total, toxic))
            ti, xi = ti[:, None], xi[:, None]
            four = [(1, both, bad), (-1, ti - both, xi - bad), (-1, tj - both, xj - bad), (1, n - ti - tj + both, pos - xi - xj + bad)]
            contrast = np.zeros_like(both)
            spread = np.zeros_like(both)
            for sign, many, some in four:
                o, e = odds(many, some)
                contrast += sign * o
                spread += e
            z = np.abs(contrast) / np.sqrt(spread)
            if i == j:
                np.fill_diagonal(z, 0)  # a slot is no pair with itself
            np.maximum(best[i : i + PAIR_BLOCK], z.max(1), out=best[i : i + PAIR_BLOCK])
            np.maximum(best[j : j + PAIR_BLOCK], z.max(0), out=best[j : j + PAIR_BLOCK])
    return candidates[best >= least]


def choose(slots: list[np.ndarray], labels: np.ndarray, columns: int = COLUMNS) -> np.ndarray:
    """The slots of the model: those that tell the labels apart alone, at most `columns`, and those that do so in pairs."""
    n, pos = len(labels), int(labels.sum())
    flat = np.concatenate(slots)
    owner = np.repeat(labels, [len(s) for s in slots])
    a = np.bincount(flat[owner == 1], minlength=SLOTS).astype(float)
    total = a + np.bincount(flat[owner == 0], minlength=SLOTS)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(n * (a * (n - pos) - (total - a) * pos) ** 2 / (pos * (n - pos) * total * (n - total)))
    del flat, owner
    chi[total < 3] = 0
    alone = np.argsort(-chi, kind="stable")[: min(columns, int((chi >= CHI).sum()))]
    often = np.flatnonzero((total >= max(3, PAIR_SHARE * n)) & (n - total >= 3))
    return np.union1d(alone, interacting(slots, labels, often)).astype(np.int32)


def fit(slots: list[np.ndarray], labels: np.ndarray, columns: int = COLUMNS, factors: int = FACTORS, seed: int = 7) -> Model:
    n, pos = len(labels), int(labels.sum())
    bias = float(np.log((pos + 1) / (n - pos + 1)))
    if not 0 < pos < n:
        return Model(np.empty(0, np.int32), bias, np.zeros(0), np.zeros((0, factors)))
    chosen = choose(slots, labels, columns)
    index = np.full(SLOTS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    rows = [c[c >= 0] for c in (index[s] for s in slots)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors))
    model = Model(chosen, bias, w, v)
    sw, sv, sb = np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
    steps = max(1, n // BATCH)
    for _ in range(max(EPOCHS, STEPS // steps)):  # at least STEPS steps on few rows
        for at in np.array_split(rng.permutation(n), steps):
            part = [rows[i] for i in at]
            grad = model.scores(part) - labels[at]
            model.bias -= RATE * (g := grad.mean()) / np.sqrt(sb := sb + g * g)
            sizes = [len(r) for r in part]
            if not sum(sizes):
                continue
            idx, row = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
            sums = _sums(v[idx], row, len(part))
            each = grad[row]
            used, inverse = np.unique(idx, return_inverse=True)
            gw = np.bincount(inverse, each) / len(at) + DECAY * w[used]
            gv = _sums(each[:, None] * (sums[row] - v[idx]), inverse, len(used)) / len(at) + DECAY * v[used]
            sw[used] += gw**2
            sv[used] += gv**2
            w[used] -= RATE * gw / np.sqrt(sw[used])
            v[used] -= RATE * gv / np.sqrt(sv[used])
    return model


class _Columns(dict):
    """Word -> model columns of its forms; emptied when it grows too large."""

    def __init__(self, columns: np.ndarray):
        super().__init__()
        self.index = {int(s): i for i, s in enumerate(columns)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(c for s in slots_of(word) if (c := self.index.get(s)) is not None)
        return found


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    memo = _Columns(model.columns)
    for batch in batches:
        rows = [np.array(sorted({c for w in terms(t) for c in memo[w]}), np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows), pa.float64())], names=["id", "score"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """Fit on at most `max_fit` of the labelled rows given."""
    small_batches(docs.sparkSession)
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_fit)
    # at most max_fit rows are broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "label", "text")
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(_features, f"id {kind}, label int, slots binary").groupBy("id").agg(F.min("slots").alias("slots"), F.first("label").alias("label")).orderBy("id").toArrow()
    slots = [np.frombuffer(b, np.int32) for b in got.column("slots").to_pylist()]
    return fit(slots, np.array(got.column("label").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of `docs`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_score, model=model), f"id {kind}, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str):
    """Whether a row is kept from fitting: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
