"""Corpus operators against brute force, and on nulls, empty and long texts, ties and empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import anchors, decontaminate, html_text, license_scan, minhash_dedup, packing, quality, sharding, suffix_dedup, toxicity, url_filter
from lodestone.llm.components import components

DOCS = "doc_id long, text string, lang string, id long, key string, shard int, size string"


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus() -> list[tuple[int, str | None]]:
    """Plain, near, exact, short, empty, null, long, periodic and shared texts."""
    rng, out = random.Random(5), []
    for k in range(30):
        out.append(" ".join(words(k, 40 + 7 * k)))
    base = words(99, 200)
    for k in range(12):  # near copies: a chain of small changes
        base = base[:]
        base[rng.randrange(200)] = f"x{k}"
        out.append(" ".join(base))
    out += [out[3], out[3], "one two", "one two", "One Two", "", None, "  \n\t ", "solo"]
    out.append(" ".join(words(7, 30_000)))
    out.append("Hello again. " * 300)
    shared = " ".join(words(123, 60))
    out += [f"{' '.join(words(200 + k, 50))} {shared} {' '.join(words(300 + k, 50))}" for k in range(5)]
    return list(enumerate(out))


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", -1, "k", 3, "s") for i, t in rows], DOCS)


EMPTY: list = []


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [*corpus(), (3, corpus()[3][1])]).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), (3, corpus()[3][1])]


# 1


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "share"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_match_brute_force(docs, rows, n, share):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if share[1] * k >= share[0] * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    got = minhash_dedup.near_duplicates(docs, words=n, threshold=share).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))


def test_near_duplicates_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    base = words(1, 150)
    rows = []
    for k in range(20):
        base = base[:]
        base[(7 * k) % 150] = f"y{k}"
        rows.append((k, " ".join(base)))
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_near_duplicates_null_ids_and_empty_table(spark):
    got = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, None)])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 4, False), (4, 4, True), (None, None, True)}
    assert minhash_dedup.near_duplicates(frame(spark, EMPTY)).count() == 0


def test_near_copies_with_null_ids_are_linked(spark):
    base = words(3, 200)
    near, far = [*base[:100], "x", *base[101:]], [*base[:50], "y", *base[51:]]
    rows = [(7, " ".join(base)), (None, " ".join(near)), (None, " ".join(far)), (None, " ".join(words(4, 200)))]
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(7, 7, True), (None, 7, False), (None, 7, False), (None, None, True)], key=repr)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2700], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    regs = minhash_dedup.registers(np.concatenate([a, b]), np.repeat([0, 1], 3000), 2)
    assert abs((regs[0] == regs[1]).mean() - 2700 / 3300) < 0.15
    union = minhash_dedup.registers(np.unique(np.concatenate([a, b])), np.zeros(len(np.unique(np.concatenate([a, b]))), np.int64), 1)
    assert (union[0] == np.maximum(regs[0], regs[1])).all()  # mergeable


def test_components_of_a_path_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2


def test_quality_counts_match_brute_force(docs, rows):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    want = defaultdict(list)
    for i, t in rows:
        t = t or ""
        w = split.findall(t)
        five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(5)}
        seen, lines = set(), 0
        for line in t.split("\n"):
            if split.search(line):
                lines += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i].append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(covered), failed))
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_fertility_equals_whole_text_tokens(spark):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "The committee approved the yearly plan after a long and open debate about housing; the plan was the first of its kind."
    r = quality.quality(frame(spark, [(1, text), (2, "\u20bf\u20bf\u20bf \u20bf \U0001f9ff\U0001f9ff " * 9)])).orderBy("doc_id").collect()
    ids = tokens.encode_ordinary(" " + text)
    counts = np.array(list(Counter(ids).values())) / len(ids)
    assert (r[0].n_pieces, r[0].n_tokens) == (len(model.encode(text)), len(ids)) and r[0].kept and r[0].fallback_share == 0
    chars = len(text.replace(" ", ""))
    assert r[0].token_entropy == pytest.approx(-(counts * np.log2(counts)).sum()) and r[0].chars_per_token == pytest.approx(chars / len(ids)) and r[0].chars_per_piece == pytest.approx(chars / r[0].n_pieces)
    assert r[1].fallback_share > 0.8 and quality.quality(frame(spark, EMPTY)).count() == 0


def test_quality_of_very_long_and_strange_texts(spark):
    rows = [(1, "a" * 300_000), (2, "the plan of a house " * 30_000), (3, "\x00 \ufeff \u2028 \xa0 " * 20), (4, "\u3000" * 50), (5, "|" * 40 + " x" * 20)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert got[1].n_words == 1 and got[1].word_chars == 300_000 and not got[1].kept
    assert got[2].n_words == 150_000 and got[2].n_repeat_words == 150_000 and not got[2].kept and got[3].n_words == 80 and got[4].n_words == 1


def test_the_memo_of_words_starts_afresh(monkeypatch):
    texts = [" ".join(words(k, 50)) for k in range(6)]
    whole = quality.Vocabulary(quality.vocabulary_paths())
    whole.learn([w.encode() for t in texts for w in dict.fromkeys(t.split()) if w.encode() not in whole])
    monkeypatch.setattr(quality, "MEMO_WORDS", 1)
    small = quality.Vocabulary(quality.vocabulary_paths())
    for t in texts:
        some = [w.encode() for w in dict.fromkeys(t.split())]
        small.learn(some)
        number = lambda v: np.array([v[w.encode()] for w in t.split()])
        assert small.fertility(number(small)) == whole_fertility(t, small.__class__)


def whole_fertility(text, make):
    fresh = make(quality.vocabulary_paths())
    fresh.learn([w.encode() for w in dict.fromkeys(text.split())])
    return fresh.fertility(np.array([fresh[w.encode()] for w in text.split()]))


def test_bands_of_languages_are_fitted_on_labelled_rows(spark):
    """Junk of many short pieces in a language with labelled prose is turned away; prose, other languages and unknown ones are not."""
    rng = random.Random(4)
    plain = "the committee approved a plan for an old river bridge and its garden which people of many towns had wanted since winter".split()
    prose = lambda k: " ".join(random.Random(k * 1000 + j).choice(plain) for j in range(150))
    parts = "th he in er an re on at en nd ti es or te".split()
    junk = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) + " |" for _ in range(n))
    rows = [(k, prose(k), "en") for k in range(120)] + [(200, junk(300), "en"), (201, junk(300), "en-GB"), (202, junk(300), None), (203, junk(300), "xx"), (204, prose(9), "en"), (205, prose(3), "de"), (0, "again " * 99, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 200)) for k in [*range(120), *range(200, 206), 9999]] + [(None, 1), (5, None)], "doc_id long, quality int")
    floors = quality.fit_bands(docs, labels)
    assert set(floors) == {"en"}
    got = {r.doc_id: r for r in quality.quality(docs, floors=floors).where("doc_id >= 200").collect()}
    assert "language" not in got[204].asDict() and not any(r.base_failed for r in got.values())
    assert {k: r.kept for k, r in got.items()} == {200: False, 201: False, 202: True, 203: True, 204: True, 205: True} and got[200].band_failed == "language"
    assert quality.fit_bands(docs, labels.limit(0)) == {} and quality.fit_bands(docs, labels, max_fit=10) == {}
    assert quality.quality(docs.where("doc_id < 120"), floors=floors).where("not kept").count() <= 4


# 3


def shards_used(sizes: list[int], most: int, alone: bool) -> int:
    used, at = 0, most + 1
    for x in sizes:
        if at + x > most:
            used, at = used + 1, 0
        at += x
        if x > most and not alone:
            return len(sizes) + 10**6
    return used


def least_capacity(sizes: list[int], shards: int, alone: bool) -> int:
    """By search over all capacities; with `alone`, a group above it may be a shard by itself."""
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards_used(sizes, mid, alone) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("digits", "shards"), [(1, 7), (4, 7), (2, 40)])
def test_shards_are_minimax_and_whole(docs, rows, monkeypatch, digits, shards):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    got = sharding.shard_by_bytes(docs, shards=shards).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    group = {i: hashlib.md5((t or "").encode()).hexdigest() for i, t in rows}
    places, where, totals, held = defaultdict(list), defaultdict(set), Counter(), Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode()) and r.grown_shard is None and r.law == "bytes"
        places[r.shard].append(r.slot)
        where[group[r.doc_id]].add(r.shard)
        totals[r.shard] += r["size"]
        held[group[r.doc_id]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(s) == 1 for s in where.values())
    order = sorted(held)
    assert [min(where[g]) for g in order] == sorted(min(where[g]) for g in order)  # contiguous
    sizes = [held[g] for g in order]
    most = least_capacity(sizes, shards, alone=True)
    groups = Counter(min(x) for x in where.values())
    assert all(t <= most or groups[k] == 1 for k, t in totals.items()) and max(totals.values()) == least_capacity(sizes, shards, alone=False)
    assert max(totals) < shards


@pytest.mark.parametrize("seed", range(40))
def test_the_walk_over_buckets_is_exact(seed):
    """Buckets of one group each against coarse ones that are split where needed."""
    rng = random.Random(seed)
    groups = {f"{rng.randrange(16**4):04x}": rng.choice([20, 30, 50, 90, 5000]) if rng.random() < 0.9 else rng.randrange(1, 20_000) for _ in range(rng.randint(1, 60))}
    shards = rng.randint(1, 12)

    def buckets(digits, wanted=None):
        found = defaultdict(list)
        for g, x in groups.items():
            if wanted is None or any(g.startswith(w) for w in wanted):
                found[g[:digits]].append(x)
        return [(p, sum(x), len(x), max(x)) for p, x in found.items()]

    digits, order = 1, sharding._Order(buckets(1))
    while True:
        low, high = order.least(shards, sure=False), order.least(shards, sure=True)
        split = order.unsure(low, high, shards)
        if not split:
            break
        digits += 1
        order = sharding._Order([x for x in order.items if x[0] not in split] + buckets(digits, split))
    sizes = [groups[g] for g in sorted(groups)]
    assert order.least(shards, sure=True) == least_capacity(sizes, shards, alone=True)
    assert order.walk(order.least(shards, sure=True), shards) == sharding._Order(buckets(4)).walk(least_capacity(sizes, shards, alone=True), shards)


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(frame(spark, EMPTY)).count() == 0
    got = sharding.shard_by_bytes(frame(spark, [(1, None), (1, None), (None, "")]), shards=3).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == [0, 1, 2]


# 4


def contaminated(rows, items):
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = defaultdict(set)
    for i, t in items:
        w = split.findall((t or "").encode().lower())
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            known[tuple(w[k : k + n])].add(str(i))
    out = defaultdict(list)
    for i, t in rows:
        w = split.findall((t or "").encode().lower())
        covered, hit = set(), set()
        for n in {len(x) for x in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    covered.update(range(k, k + n))
                    hit |= known[tuple(w[k : k + n])]
        out[i].append((len(w), len(covered), len(hit), hashlib.sha256(",".join(sorted(hit)).encode()).hexdigest(), len(covered) > 0 and 20 * len(covered) >= len(w)))
    return out


def test_the_map_of_runs_grows_with_the_benchmark():
    assert [decontaminate.slots_for(n) for n in (0, 8192, 8193, 10**9)] == [1 << 17, 1 << 17, 1 << 18, 1 << 24]


@pytest.mark.parametrize("most", [0, 50_000])
def test_contamination_matches_brute_force(spark, docs, rows, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "LEAST_SLOTS", 1 << 16)
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(7, " ".join(texts[0].split()[5:30])), (8, texts[4].upper()), (9, "one, TWO"), (10, None), (11, "..."), (12, " ".join(texts[0].split()[20:33])), (8, texts[4].upper()), (13, "É" + " é x" * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = decontaminate.contamination
    monkeypatch.setattr(decontaminate, "contamination", lambda *a, **k: real(*a, max_set=most, **k))
    extra = frame(spark, [(900, "É é x é x é x é X é x é x é x é x é x"), (901, "é é x é x é x é x é x é x é x é x é x"), (902, "a" * 300_000)])
    got = decontaminate.contamination_report(docs.unionByName(extra), bench).collect()
    want = contaminated([*rows, *[(r.doc_id, r.text) for r in extra.collect()]], items)
    assert len(got) == len(rows) + 3 and sum(r.n_hit > 0 for r in got) >= 5
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) in want[r.doc_id]


def test_decontaminate_documents_and_spans(spark):
    passage = " ".join(words(1, 20))
    docs = frame(spark, [(1, f"{passage}!"), (2, f"... {' '.join(words(2, 500))} ({passage}), the end"), (3, "clean"), (4, None), (1, f"{passage}!")])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, spans=True).collect()}
    assert cut[1] == "" and cut[3] == "clean" and cut[4] is None and cut[2] == f"... {' '.join(words(2, 500))} (the end"
    assert decontaminate.contamination_report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination_report(docs.limit(0), bench).count() == 0


# 5


def pure_pairs(rows, pool, seed):
    """Rows whose label is whether exactly one of terms 1 and 2 is there, among 30 of `pool` other terms."""
    rng = np.random.default_rng(seed)
    a, b = rng.random(rows) < 0.5, rng.random(rows) < 0.5
    found = [np.unique([*[1] * int(p), *[2] * int(q), *(10 + rng.choice(pool, 30, replace=False))]).astype(np.int32) for p, q in zip(a, b, strict=True)]
    return found, (a ^ b).astype(np.int64)


@pytest.mark.parametrize("pool", [60, 5000, 60_000])
def test_toxicity_model_learns_pure_interactions(pool):
    for seed in (0, 1):
        rows, labels = pure_pairs(4000, pool, seed)
        model = toxicity.fit(rows[:3000], labels[:3000])
        assert {1, 2} <= set(model.columns.tolist())
        index = {int(c): k for k, c in enumerate(model.columns)}
        held = [np.array([index[c] for c in r.tolist() if c in index], np.int64) for r in rows[3000:]]
        assert ((model.scores(held) >= 0.5) == labels[3000:]).mean() > 0.95


def test_pair_statistics_and_scores_match_plain_loops():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 300)
    rows = [np.flatnonzero(rng.random(40) < np.where(np.arange(40) % 7 == 0, 0.2 + 0.6 * y, 0.4)).astype(np.int32) for y in labels]
    candidates, least = np.arange(1, 40), 2.2

    def z(i, j):
        total, spread = 0.0, 0.0
        for left, right, sign in ((True, True, 1), (True, False, -1), (False, True, -1), (False, False, 1)):
            cell = [y for r, y in zip(rows, labels, strict=True) if (i in r) == left and (j in r) == right]
            bad, good = sum(cell) + 0.5, len(cell) - sum(cell) + 0.5
            total, spread = total + sign * np.log(bad / good), spread + 1 / bad + 1 / good
        return abs(total) / spread**0.5

    best = {i: max(z(i, j) for j in candidates if j != i) for i in candidates.tolist()}
    before, toxicity.PAIR_BLOCK = toxicity.PAIR_BLOCK, 16
    try:
        got = set(toxicity.interacting(rows, labels, candidates, least).tolist())
    finally:
        toxicity.PAIR_BLOCK = before
    near = {i for i, b in best.items() if abs(b - least) < 1e-3}
    assert got - near == {i for i, b in best.items() if b >= least} - near and 0 < len(got) < 39
    model = toxicity.Model(np.arange(40), 0.3, rng.normal(size=40), rng.normal(size=(40, 4)))
    for row, score in zip(rows, model.scores(rows), strict=True):
        plain = 0.3 + sum(model.weights[i] for i in row) + sum(model.factors[i] @ model.factors[j] for k, i in enumerate(row) for j in row[k + 1 :])
        assert abs(score - 1 / (1 + np.exp(-np.clip(plain, -30, 30)))) < 1e-9


def test_toxicity_learns_pairs_and_scores_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(1500):
        w = words(k, 30, 300)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["rotten"] * insult + ["neighbours"] * group
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(insult and group)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where(~toxicity.held_out("doc_id")))
    got = toxicity.score(docs, model).join(marks, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(got) > 300 and sum((r.score >= 0.5) == (r.toxic == 1) for r in got) / len(got) > 0.9
    strange = toxicity.score(frame(spark, [(1, None), (2, ""), (3, "x " * 200_000)]), model).collect()
    assert all(0 <= r.score <= 1 for r in strange) and toxicity.score(docs.limit(0), model).count() == 0
    blank = toxicity.train(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}


# 6


def repeats(rows):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = defaultdict(list)
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        out[i].append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "batch"), [(50_000, 20_000), (1, 20_000), (50_000, 3)])
def test_repeated_bytes_match_brute_force(spark, docs, rows, monkeypatch, hot, batch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rng = random.Random(8)
    body = "".join(rng.choice("ab é") for _ in range(900))
    more = [(500, body), (501, "x" + body[100:500]), (502, body[300:700] + "yy" + body[350:560]), (503, "a" * 450), (504, "ab" * 300), (505, body[:199]), (506, body[:200])]
    got = suffix_dedup.remove_repeats(docs.unionByName(frame(spark, more))).collect()
    want = repeats([*rows, *more])
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_runs_cover_every_window():
    texts = [b"", b"a" * 199, bytes(random.Random(1).randbytes(5000)), b"z" * 700]
    r = anchors.Runs(texts)
    for k, t in enumerate(texts):
        covered = sorted((f, c) for x, f, c in zip(r.text, r.first, r.count, strict=True) if x == k)
        assert sum(c for _, c in covered) == max(0, len(t) - 199)
        assert all(a + c == b for (a, c), (b, _) in zip(covered, covered[1:], strict=False))


# 7


def test_packing_is_whole_and_tight(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(800, "a <|endoftext|> b"), (801, "  tabs\t\tand  spaces \n\n"), (802, "don't stop, they'll see 12345 \u00e9\u00e8 \u4e2d\u6587 \U0001f600")]
    got = packing.pack(docs.unionByName(frame(spark, extra))).collect()
    tokens = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in [*rows, *extra]}
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        part = tokens[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, _ in [*rows, *extra])
    for i, p in pieces.items():
        n = len(tokens[i])
        want = [(k, s, m) for k, (s, m) in enumerate(packing.pieces(n, 1024))]
        assert sorted(p) == sorted(want * copies[i]) and (n > 1024 or len(want) == 1)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    least = math.ceil(sum(len(tokens[i]) * c for i, c in copies.items()) / 1024)
    assert len(bins) <= least + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_fill_uses_each_piece_once_and_finds_full_bins():
    rng = random.Random(4)
    counts = Counter(min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(3000))
    bins = packing.fill(dict(counts), 100)
    got = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 100 and times > 0
        for n in lengths:
            got[n] += times
    assert got == counts and sum(t for _, t in bins) <= math.ceil(sum(n * c for n, c in counts.items()) / 100) + 1
    assert packing.fill({60: 1, 40: 1, 50: 2, 35: 1, 5: 1}, 100) == [([60, 40], 1), ([50, 50], 1), ([35, 5], 1)]


# 8


@pytest.mark.parametrize("share", [100_000, 7])
def test_url_rules_match_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(url_filter, "SHARE", share)
    rng = random.Random(6)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.net", ""), ("allow", "b.a.net", "/x"), ("block", "ample.com", "/en/"), ("block", "b.a.net", "/x/y"), ("allow", "example.com", "/en/"), ("block", "a.com", ""), *(("block", "many.org", f"/{k % 17}" + "/a" * (k % 5)) for k in range(85))]
    hosts = ["a\x01b.com", "b\x01.a.com", "a\x02b.com", "x.many.org", "many.org", "example.com", "WWW.Example.com", "m.www.example.com", "a.net", "b.a.net", "c.b.a.net", "net", "com", "xample.com", "anet", "", "EXAMPLE.com.", "é.net"]
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/1', '/x', '/x/y/z', '?/en/', '#a', '/a?b#c', '/en/?q://z/', '/3/a/a/b', '/16/a/a/a/a/a', '/1', '/30'])}" for _ in range(900)]
    urls.append("http://m.a.net/" + "x" * 200_000)
    urls += [None, "", "nothing", "a.com/en/", "://", "http://"]
    pages = spark.createDataFrame([(k, u, "com", 1) for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, part int")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = [*urls, urls[0]][r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        fit = [(n, h, v) for n, h, v in fit if v == min(w for _, g, w in fit if g == h)]  # equal rules: the first verdict
        best = max(fit, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[2] if best else "allow")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}


# 9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use it</div>
<article><h1>Big &amp; small</h1><p>First <b>bold</b> text<br>goes on<p>Second&nbsp;one &lt;tag&gt;<aside>not this</aside><ul><li>x<li>y</ul>
<form><input value="q"><label>Search</label></form><div class="ad">Buy</div><section class="comments"><p>Nice post</p></section></article>
<aside class="sidebar"><p>Other</p></aside><footer>&copy; site</footer></body></html>"""


def test_main_text_of_a_framed_page():
    assert html_text.main_text(PAGE) == "Big & small First bold text goes on Second one <tag> x y"


def test_articles_by_class():
    assert html_text.main_text('<main><article class="ad-free post"><p>Body</p></article><article class="comment odd"><p>Nice</p></article></main>') == "Body"
    assert html_text.main_text('<nav><a href="/">Home</a></nav><article><p>One <a href="/x">two</a></p><p><a href="/y">three</a></p></article>') == "One two three"


def test_main_text_by_density_alone():
    good = "This is the kind of prose that has many of the common words in it, and it goes on for a while so that it is long enough to be told from the rest. "
    page = f"<body><div><a href='/'>Home</a> <a href='/x'>Other page</a></div><p>{good}</p><p>Short one.</p><p>{good}</p><div><a>more</a></div><p>Buy now</p></body>"
    assert html_text.main_text(page) == f"{good.strip()} Short one. {good.strip()}"


@pytest.mark.parametrize("n", [1, 20, 21, 39, 40, 500])
def test_long_runs_of_short_blocks_take_the_label_of_both_sides(n):
    good = "This is the kind of prose that has many of the common words in it, and it goes on for a while so that it is long enough to be told from the rest. "
    items = [f"Line {k}" for k in range(n)]
    runs = "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    assert html_text.main_text(f"<body><p>{good}</p>{runs}<p>{good}</p></body>") == " ".join([good.strip(), *items, good.strip()])
    assert html_text.main_text(f"<body><div><a href='/'>Home</a></div>{runs}<div><a href='/x'>More</a></div><p>{good}</p></body>") == good.strip()
    assert html_text.main_text(f"<body>{runs}</body>") == " ".join(items)  # nothing is decided: all is kept, as before


def test_quotes_buttons_and_nested_frames():
    cases = {
        '<article><p>One <a href="x>two</a></p><p>three</p></article>': "One two three",
        "<article><p title='a > b' class=\"it's\">One</p><p don't>two</article>": "One two",
        "<article><p>One <button type=button>Share this</button> two</p><button>Like</button></article>": "One two",
        "<article><button>kept, as it has no end<p>three</p></article>": "kept, as it has no end three",
        "<main><div>Teaser</div><article><p>Body</p></article></main>": "Body",
        '<article><div class="product-menu-item">Item</div><div class="main-menu">No</div><div class="ad-slot">No</div></article>': "Item",
        "<article><p><a href=q>all linked</a></p></article>": "all linked",
    }
    for markup, want in cases.items():
        assert html_text.main_text(markup) == want


@pytest.mark.parametrize("frame", ["article", "main", "div", "section"])
def test_pages_made_of_known_blocks(frame):
    """Whatever the article's element is called, its blocks come back and the rest does not."""
    rng = random.Random(len(frame))
    stock = "the of and in to a is that house garden river winter quiet letter".split()
    chrome = ["<nav><ul><li><a href='/x'>Home page</a><li><a href='/y'>More</a></ul></nav>", '<div class="ad">Buy the best of it in a shop</div>', "<aside><p>Other</p></aside>", "<footer>&copy; the site</footer>", "<form><label>Your name</label><input></form>", '<div class="cookie-notice">We use it</div>']
    for _ in range(60):
        blocks = [" ".join(rng.choice(stock) for _ in range(rng.choice([1, 2, 12, 40, 120]))) + rng.choice([".", " & co", " <x>", " caf\u00e9"]) for _ in range(rng.randint(1, 12))]
        blocks.append(" ".join(rng.choice(stock) for _ in range(60)))
        inner = ""
        for b in blocks:
            tag = rng.choice(["p", "h2", "div", "blockquote", "li"])
            body = b.replace("&", rng.choice(["&amp;", "&#38;"])).replace("<", "&lt;").replace("\u00e9", rng.choice(["&eacute;", "&#xe9;", "\u00e9"])).replace(" ", rng.choice([" ", "\n  ", " <b>", " <i></i>"]), 1)
            inner += f"<{tag} data-k='a>b'>{body}" + (f"</{tag}>" if rng.random() < 0.6 or tag in ("div", "blockquote") else "")
        before, after = rng.sample(chrome, 2)
        page = f"<!DOCTYPE html><html><head><title>T</title><script>var a = '<p>';</script></head><body>{before}<{frame}>{inner}</{frame}>{after}</body></html>"
        assert html_text.main_text(page) == " ".join(blocks)


def test_main_text_of_broken_and_empty_markup(spark):
    cases = {None: "", "": "", "<article><p>cut off in a <a hre": "cut off in a", "<article>a &amp b &#x41; &bogus; <!-- no": "a & b A &bogus;", "<article><p>" + "long " * 50_000: ("long " * 50_000).strip()}
    pages = spark.createDataFrame([(k, "u", h, "t") for k, h in enumerate(cases)] + [(0, "u", None, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        want = list(cases.values())[r.page_id]
        assert (r.text, r.n_chars, r.url) == (want, len(want), "u")
    assert html_text.extract_text(pages.limit(0)).count() == 0


# 10


def test_license_places_and_labels(spark):
    mit = license_scan.TEMPLATES[0][1]
    texts = ["MIT license, mit-license; the Apache License", None, "", "gnu GENERAL public\nlicense general public license", f"word {mit.title()}!", "mit", " ".join(mit.split()[::2]), "a " * 200_000 + "mit license", f"{mit[:150]} inserted words {mit[150:]}"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, [*enumerate(texts), (0, texts[0])])).collect()}
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, t in enumerate(texts):
        w = [x.decode() for x in split.findall((t or "").encode().lower())]
        at, base = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += here
            base |= {label} if here else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[4].labels == "mit" and got[4].score == 1.0 and got[8].labels == "mit" and got[6].labels == "" and got[5].labels == ""
    assert license_scan.scan_licenses(frame(spark, EMPTY)).count() == 0


def test_license_versions_and_families():
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "CC-BY-NC-SA 4.0": "cc-by-nc-sa-4.0",
        "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
        "https://creativecommons.org/licenses/by/4.0/": "cc-by-4.0",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "by the way, 4.0 of 5.0 nc": "",
    }
    for text, want in cases.items():
        assert license_scan.scan_text(text)[5] == want
    bsd = {label: text for label, text, _ in license_scan.TEMPLATES if label.startswith("bsd")}
    assert license_scan.scan_text(bsd["bsd-2-clause"])[5] == "bsd-2-clause"
    assert license_scan.scan_text(bsd["bsd-2-clause"] + " and " + bsd["bsd-3-clause"])[5] == "bsd-3-clause"
    notice = next(t for label, t, _ in license_scan.family_templates() if label == "gpl-2.0-or-later").split()
    assert license_scan.scan_text(" ".join([*notice[:9], *["extra"] * 4, *notice[9:]]))[5] == "gpl,gpl-2.0-or-later"  # within the drift
    assert license_scan.scan_text(" ".join([*notice[:20], *["extra"] * 30, *notice[20:]]))[5] == "gpl"  # beyond it


def test_license_index_matches_a_naive_alignment():
    """Without the index: every template at every place of the file, word by word."""
    templates = [(label, text, needed) for label, text, needed in [*license_scan.TEMPLATES, *license_scan.family_templates()] if len(text.split()) < license_scan.DRIFT]
    index = license_scan.Index(templates)
    rng = random.Random(12)
    weights = [{k: w for of in index.postings.values() for u, k, w in of if u == t} for t in range(len(templates))]
    for _ in range(150):
        parts = [rng.choice(templates)[1] if rng.random() < 0.5 else rng.choice(["the gnu", "version 3", "cc by", "4 0", "licenses by nc", "license"]) for _ in range(6)]
        words = [w.encode() for w in " ".join(parts).split() if rng.random() < 0.97]
        want = Counter()
        for t, (label, text, needed) in enumerate(templates):
            mine, best = text.encode().split(), 0.0
            for at in range(-len(mine) + 1, len(words)):
                weight = sum(w for k, w in weights[t].items() if 0 <= at + k < len(words) and words[at + k] == mine[k])
                here = b" " + b" ".join(words[max(0, at) : at + len(mine)]) + b" "
                if weight >= (license_scan.LEAST - 1e-9) * index.total[t] and all(f" {p} ".encode() in here for p in needed):
                    best = max(best, weight)
            if best:
                want[label, round(min(1.0, best / index.total[t]), 6)] += 1
        assert Counter((x[0], x[3]) for x in index.findings(words)) == want


def test_every_query_is_registered():
    from lodestone.llm.queries import QUERIES

    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))
    assert json.dumps(sorted(QUERIES))


def test_bands_are_fitted_on_every_good_row(spark):
    """rows beyond the first 12,000 by a hash of the id had no say. Here they are the ones with the least characters per token."""
    from pyspark.sql import functions as F

    n, odd = 12_060, 60
    last = {r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc(), F.desc("id")).limit(odd).collect()}
    rows = [(k, " ".join(["qx zj vk wq"] * 1 + [f"xq{k} jz vqx kzq xj qj zx vjq"]) if k in last else f"the old river bridge and its garden were built by people of many towns {k}", "en") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality")
    ratios = sorted(r.chars_per_token for r in quality.measures(docs).where("not base_failed").select("chars_per_token").collect())
    least = float(np.quantile(ratios, quality.FALSE_REJECTION, method="lower"))
    assert quality.fit_bands(docs, labels)["en"][0] == least < quality.fit_bands(docs, labels, max_fit=12_000)["en"][0]


def test_quality_with_labels_measures_texts_once_and_shuffles_none(spark, tmp_path, monkeypatch):
    """Round 3, op2: good rows were tokenised twice, and all texts were shuffled to meet the labels once these were too many for a broadcast."""
    from lodestone.llm import queries

    plain = "the committee approved a plan for an old river bridge and its garden which people of many towns had wanted since winter".split()
    rows = [(k % 190, " ".join(random.Random(k).choice(plain) for _ in range(20 + k)), "en") for k in range(200)] + [(300, "again " * 99, "en"), (301, None, "en"), (None, " ".join(plain), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(150).selectExpr("id as doc_id", "1 as quality").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    want = sorted(map(tuple, quality.quality(docs, floors=quality.fit_bands(docs, labels)).collect()), key=repr)
    calls, inner = [], quality.measures
    monkeypatch.setattr(quality, "measures", lambda *a, **b: calls.append(1) or inner(*a, **b))
    got = queries.op2_quality_rules(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(calls) == 1
    assert got.inputFiles() and not any("documents.parquet" in f for f in got.inputFiles())
