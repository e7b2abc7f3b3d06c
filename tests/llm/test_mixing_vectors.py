"""Mixing, vector codes and whitening against plain versions, and on nulls, ties, ragged and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodestone.llm import mixing, vector_codes, whitening

DOCS = "doc_id long, text string, source string, size long, target double, key string, range int"
VECTORS = "vec_id long, embedding array<float>, label int, v string, id int, part int, share string"


def documents(spark, rows):
    """With extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, s, -1, -1.0, "k", 3) for i, t, s in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, 1, "s") for i, v, label in rows], VECTORS)


def shared_words(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by sharing what is above the bounds again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while free and rest > 0:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= target[s]
            free.remove(s)
    return target


def mixed(rows) -> list[tuple]:
    """(doc_id, size, source_size, target, taken), by sorting whole sources."""
    known = []
    for i, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        symbols = len(re.findall(r"[#*$%&|<>{}\[\]=\\]", text or ""))
        u = (int(hashlib.md5(f"{'' if i is None else i}|{text or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = (0.5 if size < 10 else 1.0) * size / (size + 4 * symbols + 1)
        known.append((source, -math.log(u) / w if size else 0.0, i is None, i or 0, i, size))
    sizes: dict = {}
    for k in known:
        sizes[k[0]] = sizes.get(k[0], 0) + k[-1]
    target, out = shared_words(sizes), []
    for source, whole in sizes.items():
        epochs = int(target[source] // whole) if whole else 0
        rest = math.floor(target[source] - epochs * whole + 0.5)
        for _, _, _, _, i, size in sorted((k for k in known if k[0] == source), key=lambda k: k[1:4]):
            extra = max(0, min(rest, size))
            rest -= extra
            out.append((i, size, whole, round(target[source], 6), epochs * size + extra))
    return sorted(out, key=repr)


def result(df, *more) -> list[tuple]:
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], *[r[m] for m in more]) for r in df.collect()), key=repr)


def random_documents(seed: int, sources: int, n: int = 200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.1 else f"s{int(rng.random() ** 3 * sources):02d}"
        text = rng.choice([None, "", " \t\n", "one", "a " * rng.randrange(200), "x # y % " * rng.randrange(9), "word " * rng.randrange(3000)]) if rng.random() < 0.4 else " ".join(rng.choice("abcdef") for _ in range(rng.randrange(60)))
        rows.append((None if rng.random() < 0.05 else i, text, source))
    return rows + [(5, "the same row twice over here " * 3, "s01")] * 40


@pytest.mark.parametrize("seed,sources", [(1, 1), (2, 3), (3, 12), (4, 40)])
def test_mixture_equals_sorting_whole_sources(spark, seed, sources):
    rows = random_documents(seed, sources)
    got = mixing.mix(documents(spark, rows).repartition(5))
    assert result(got) == mixed(rows)


def test_mixture_keeps_its_bounds_and_targets(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 7}" if i % 3 else "hot") for i in range(900)]
    got = result(mixing.mix(documents(spark, rows)), "epochs")
    assert all(taken <= 3 * size for _, size, _, _, taken, _ in got)
    by_target: dict = {}
    for _, _, whole, target, taken, _ in got:
        by_target.setdefault((whole, target), []).append(taken)
    assert sum(t for _, t in by_target) == pytest.approx(sum(len(r[1].split()) for r in rows), abs=8)
    assert all(abs(sum(takes) - target) < 1 for (_, target), takes in by_target.items())
    assert {e for *_, e in got} == {0, 2}
    assert got == result(mixing.mix(documents(spark, rows[::-1]).repartition(3)), "epochs")  # whatever the order and the tasks


def test_mixture_favours_documents_of_quality(spark):
    rows = [(i, ("plain words of prose " * 5) if i % 2 else ("# % & | plain " * 4), "a" if i < 2000 else "b") for i in range(2400)]
    got = {r["doc_id"]: r for r in mixing.mix(documents(spark, rows), weights=(1, 2)).collect()}
    taken = [[r["taken"] > 0 for i, r in got.items() if i < 2000 and i % 2 == odd] for odd in (0, 1)]
    assert sum(taken[1]) > 2 * sum(taken[0]) > 0


def test_mixture_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert result(mixing.mix(documents(spark, [(1, None, None), (2, "", "a")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert [r[4] for r in result(mixing.mix(documents(spark, [(1, "a b c", None)])))] == [3]
    long = " ".join(["w"] * 400_000)
    assert result(mixing.mix(documents(spark, [(1, long, "a"), (2, "x", "b")])))[0][:3] == (1, 400_000, 400_000)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Codes and errors with Python's own integers."""
    kept = [(i, [math.floor(float(np.float32(x)) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        chosen = [[nearest(c[p], books[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, at in zip(cut, chosen[p], strict=True) if at == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], digest) for (i, _, label), f, error in zip(kept, found, errors, strict=True)), key=repr)


def coded(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_vectors(seed: int, n: int, width: int, spread: float = 0.3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, width)], int(i) % 3) for i in rng.permutation(n)]
    rows += [(1000 + k, list(rows[0][1]), None) for k in range(30)]  # copies
    bad = [None, [None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1), [-math.inf] * width]
    return rows + [(2000 + k, v, 1) for k, v in enumerate(bad)] + [(None, list(rows[3][1]), 2), (4, list(rows[9][1]), None)]


@pytest.mark.parametrize("seed,n,width,spread", [(1, 150, 16, 0.3), (2, 90, 64, 0.01), (3, 7, 8, 1.0), (4, 120, 24, 1e-3), (5, 60, 16, 3e7)])
def test_codes_equal_plain_integers(spark, seed, n, width, spread):
    rows = random_vectors(seed, n, width, spread)
    want = [(*r[:2], *(e if e < 2**63 else None for e in r[2:4]), r[4]) for r in plain_codes(rows)]
    if any(r[2] is None for r in want):
        want = [(*r[:3], None if any(x[2] is None for x in want) else r[3], r[4]) for r in want]
    got = coded(vector_codes.encode(vectors(spark, rows).repartition(4)))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    if spread < 1e6:
        assert got == want


def test_filter_never_loses_the_nearest_entry_and_refines_few():
    rng = np.random.default_rng(7)
    for width, scale in ((1, 3), (4, 50), (8, 4000)):
        entries, queries = rng.integers(-scale, scale, (16, width)), rng.integers(-2 * scale, 2 * scale, (500, width))
        cells = vector_codes.CellFilter(entries)
        best, distance = cells.nearest(queries)
        all_of = ((queries[:, None] - entries) ** 2).sum(axis=2)
        assert (best == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
    assert cells.refined < 0.5 * 500 * 16


def test_codes_of_ragged_short_and_empty_tables(spark):
    assert vector_codes.encode(vectors(spark, [])).collect() == []
    assert vector_codes.encode(vectors(spark, [(1, None, 2), (2, [math.nan], 2)])).collect() == []
    got = coded(vector_codes.encode(vectors(spark, [(1, [1.0] * 5, 0), (2, [2.0] * 5, 0), (3, [0.5] * 7, 0), (4, [1e30] * 5, 0)])))
    assert [r[:4] for r in got] == [(1, "00" * 8, 0, 0), (2, "01" * 5 + "00" * 3, 0, 0)]


def fitted(rows):
    """(id, deviation, whitened rows) with exact sums and a library's eigenvectors."""
    kept = [(i, np.array([math.floor(64 * x) + 1_000_000 for x in v])) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = [list(map(int, x)) for x in {tuple(x.tolist()): x for _, x in kept}.values()]
    n, width = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(width)]
    apart = np.array([[n * x[k] - sums[k] for k in range(width)] for x in fit], dtype=object)
    cov = (apart.T @ apart).astype(np.float64) / n**3
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:16], vecs[:, ::-1][:, :16]
    out = [(i, sum((n * int(a) - s) ** 2 for a, s in zip(x, sums, strict=True)), ((n * x - np.array(sums)) / n) @ vecs / np.sqrt(np.maximum(values, 1e-300))) for i, x in kept]
    return n, values / cov.trace(), out


@pytest.mark.parametrize("seed,n,width,tasks", [(1, 300, 20, 3), (2, 200, 64, 9), (3, 400, 5, 1)])
def test_whitening_equals_a_library(spark, seed, n, width, tasks):
    rows = [(i, [x * (1 + k) for k, x in enumerate(v)], label) if v and None not in v else (i, v, label) for i, v, label in random_vectors(seed, n, width)]
    n_fit, explained, want = fitted(rows)
    assert n_fit < len(want)
    frame = whitening.whiten(vectors(spark, rows).repartition(tasks)).toPandas()
    parts = min(16, width)
    assert len(frame) == len(want) * parts and frame["n"].eq(n_fit).all() and frame["identity_error"].max() < 1e-9 and frame["identity_error"].nunique() == 1
    shares = frame.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, explained[:parts], rtol=1e-10)
    signs = None
    for r_id, deviation, white in want:
        own = frame[(frame["deviation"] == deviation) & (frame["vec_id"].isna() if r_id is None else frame["vec_id"] == r_id)]
        got = own.groupby("component")["whitened"].first().to_numpy()
        signs = np.sign(got * white) if signs is None else signs
        assert np.allclose(got, white * signs, atol=1e-8)


def test_symmetric_qr():
    rng = np.random.default_rng(3)
    for a in (rng.normal(size=(40, 40)), np.diag([3.0, 3.0, 1.0]), np.zeros((4, 4)), np.ones((5, 5)), np.array([[2.0]]), np.diag([1.0, 1e-9, 1e9])):
        a = a + a.T
        values, vecs = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max() * len(a)))
        assert np.allclose(vecs @ vecs.T, np.eye(len(a)), atol=1e-13) and np.allclose(vecs @ a @ vecs.T, np.diag(values), atol=1e-12 * max(1, np.abs(a).max() * len(a)))


def test_moments_merge_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.integers(-90, 90, (500, 6))
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "v array<long>").repartition(23)
    monkeypatch.setattr(whitening, "MERGE_BYTES", 700)  # two shares meet at a time
    got = whitening.moments(rows, 6, 6)
    assert got.n == 500 and got.sums == x.sum(axis=0).tolist()
    assert np.allclose(got.scatter / 500, np.cov(x.T, bias=True), rtol=1e-12)


def test_whitening_of_constants_one_row_and_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 1.25], 0), (3, None, 0), (4, [0.1], 0)])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in sorted(got)] == [(1, 1, 2, 64 * 64, 1.0, 1.0), (2, 1, 2, 64 * 64, 1.0, 1.0)]
