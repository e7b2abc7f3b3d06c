"""Components, groups, merged papers and walks: long chains, many nodes, cycles, and brute force."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.operators import cliques, graph, identity, trees

PAPER = "position long, source string, external_id string, title string, first_author string, published_at string, doi string, arxiv_id string, venue string, abstract string, authors array<string>"


def paper(position, source="arxiv", title=None, author=None, year="2020-01-01", doi=None, arxiv=None, venue=None, abstract=None, authors=()):
    return (position, source, f"x{position}", title, author, year, doi, arxiv, venue, abstract, list(authors))


def test_labels_of_a_long_chain(spark):
    n = 400
    order = random.Random(1).sample(range(n), n)
    ties = [(order[k], f"k{k}") for k in range(n)] + [(order[k + 1], f"k{k}") for k in range(n - 1)] + [(1000, "z"), (1001, None)]
    got = {r.x: r.label for r in graph.label_by_keys(spark.createDataFrame(ties, "x long, key string").repartition(5), "x", "key").collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000}


def test_a_chain_of_papers_is_one_entity_wherever_it_is_long(spark):
    """Each shares its DOI with one neighbour and its title, author and year with the other."""
    rows = [paper(k, title=f"T{(k + 1) // 2}", author="Ann Lee", doi=f"10.1/{k // 2}", venue="" if k < 5 else f"v{k}") for k in range(200)]
    got = identity.resolve_entities(spark.createDataFrame(rows, PAPER).repartition(7)).collect()
    home = {r.position: r.entity_id for r in got}
    assert len(home) == 200 and all(home[2 * k] == home[2 * k + 1] for k in range(100))


def same(a, b):
    for f, g in (("doi", identity._doi), ("arxiv_id", identity._arxiv)):
        x, y = g(a[f]), g(b[f])
        if x is not None and y is not None:
            return x == y
    one = identity._fallback(a)
    return one is not None and one == identity._fallback(b)


def test_entities_match_a_plain_scan(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [paper(k, pick("arxiv", "s2"), pick("A title", "a-title!", "Other", ""), pick("O'Brien, Pat", "Pat OBrien", "Kim Li", ""), pick("2020-01-01", "2020-05-01", "2021-01-01", None), pick(None, None, "10.1/a", "https://doi.org/10.1/A", "10.1/b", ""), pick(None, None, "2401.00001v2", "arXiv:2401.00001", "2401.00002"), pick(None, "", "v1"), pick(None, "text"), pick((), ("Pat OBrien",))) for k in range(60)]
    names = [c.split()[0] for c in PAPER.split(", ")]
    merged: list[dict] = []
    want = {}
    for row in (dict(zip(names, r, strict=True)) for r in rows):
        hit = next((p for p in merged if same(p, row)), None)
        if hit is None:
            hit = {**row, "sources": []}
            merged.append(hit)
        for f in names[3:]:
            if hit[f] in (None, "", []):
                hit[f] = row[f]
        first = row["source"] not in [s for s, _ in hit["sources"]]
        if first:
            hit["sources"].append((row["source"], row["external_id"]))
        want[row["position"]] = (hit["position"], first)
    df = spark.createDataFrame(rows, PAPER).repartition(4)
    resolved = identity.resolve_entities(df)
    assert {r.position: (r.entity_id, r.is_source_row) for r in resolved.collect()} == want
    got = {r.entity_id: r for r in identity.merged_papers(df, resolved).collect()}
    assert set(got) == {p["position"] for p in merged}
    for p in merged:
        r = got[p["position"]]
        assert [(s.source, s.external_id) for s in r.sources] == p["sources"]
        assert all((r[f] or None) == (p[f] or None) for f in names[3:])


def test_keys_of_papers_without_identifiers(spark):
    rows = [("The ﬁrst: Title", "O'Brien, Pat"), ("the first title", "Pat OBRIEN"), ("!", "Pat Lee"), ("T", "?"), ("T", None)]
    df = spark.createDataFrame(rows, "t string, a string").select(ids.title_author_year(F.col("t"), F.col("a"), F.lit("2020-03-01").cast("date")).alias("k"))
    assert [r.k for r in df.collect()] == ["thefirsttitle|obrien|2020"] * 2 + [None] * 3
    d = spark.range(1).select(ids.normalize_doi(F.lit("https://dx.doi.org/10.1/A"), resolver=False).alias("a"), ids.normalize_doi(F.lit("https://dx.doi.org/10.1/A")).alias("b")).first()
    assert tuple(d) == ("https://dx.doi.org/10.1/a", "10.1/a")


def test_groups_are_complete_and_match_set_merging(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(160)} | {(100, 101), (101, 102), (100, 102)})
    accepted, groups = set(pairs), [{x} for x in {y for p in pairs for y in p}]
    for a, b in pairs:
        g, h = (next(s for s in groups if x in s) for x in (a, b))
        if g is not h and all(tuple(sorted((x, y))) in accepted for x in g for y in h):
            groups.remove(h)
            g |= h
    got = cliques.canonical_groups(spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in pairs], "left_id long, right_id long")).collect()
    assert sorted((r.canonical_id, r.claim_id) for r in got) == sorted((min(g), x) for g in groups if len(g) > 1 for x in g)


def test_trees_beyond_a_million_nodes(spark):
    """A forest of 1.2 million nodes, and one tree that is 1,500 nodes high."""
    forest = spark.range(600_000).selectExpr("id as paper_id", "explode(array(named_struct('node', 0L, 'parent', cast(null as bigint)), named_struct('node', 1L, 'parent', 0L))) as x").select("paper_id", "x.*")
    high = spark.range(1500).selectExpr("-1L as paper_id", "id as node", "case when id > 0 then id - 1 end as parent")
    got = trees.depths(forest.unionByName(high)).groupBy((F.col("paper_id") < 0).alias("high")).agg(F.count("*").alias("n"), F.max("depth").alias("most"), F.sum("depth").alias("sum")).collect()
    assert {r.high: (r.n, r.most, r.sum) for r in got} == {False: (1_200_000, 1, 600_000), True: (1500, 1499, 1499 * 750)}


def test_cycles_and_missing_parents(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 5, 6), (1, 6, 5), (1, 7, 6), (1, 8, 8), (1, 9, 77), (1, 10, 9), (2, 5, None), (2, 6, 5)]
    nodes = spark.createDataFrame(rows, "paper_id long, node long, parent long")
    assert sorted((r.paper_id, r.node, r.ancestors) for r in trees.ancestors(nodes).collect()) == [(1, 0, ""), (1, 1, "0"), (1, 2, "0/1"), (2, 5, ""), (2, 6, "5")]
    assert sorted(r.node for r in trees.unreachable(nodes).collect()) == [5, 6, 7, 8, 9, 10]
    assert trees.depths(nodes.limit(0)).count() == 0


def passes(rows):
    """Place nodes in passes, over and over, by (ordinal, node): {node: (depth, pass)} of those that get a place."""
    once = {n for n, k in Counter(r[0] for r in rows).items() if k == 1}
    left = sorted((o, n, p) for n, p, o in rows if n in once)
    out, turn = {}, 0
    while left:
        stay = []
        for o, n, p in left:
            if p is None:
                out[n] = (0, turn)
            elif p in out:
                out[n] = (out[p][0] + 1, turn)
            else:
                stay.append((o, n, p))
        if len(stay) == len(left):
            break
        left, turn = stay, turn + 1
    return out


def why_not(rows, n):
    """Follow the parents of a node up to what is wrong."""
    count, up, seen = Counter(r[0] for r in rows), {r[0]: r[1] for r in rows}, set()
    while n is not None and n not in seen:
        if n not in count:
            return "missing parent"
        if count[n] > 1:
            return "repeated"
        seen.add(n)
        n = up[n]
    return "ok" if n is None else "cycle"


def test_order_matches_repeated_passes(spark):
    rng = random.Random(11)
    rows = []
    for t in range(60):
        size = rng.choice([1, 2, 5, 30])
        for n in range(size):
            p = None if n == 0 else rng.randrange(size + 1) if t % 3 == 0 else n - 1 if rng.random() < 0.6 else rng.randrange(n)
            rows += [(t, n, p, rng.choice([1, 2, 3, 9]))] * (2 if t % 5 == 4 and rng.random() < 0.1 else 1)
    nodes = spark.createDataFrame([*rows, (None, 1, None, 1), (3, None, 0, 1)], "paper_id long, node long, parent long, ordinal int")
    got = {(r.paper_id, r.node): r for r in trees.ordered(nodes, ordinal="ordinal").collect()}
    assert set(got) == {(t, n) for t, n, *_ in rows}
    assert {r.verdict for r in got.values()} == {"ok", "missing parent", "cycle", "repeated"}
    for t in range(60):
        own = [r[1:] for r in rows if r[0] == t]
        want, ordinal = passes(own), {n: o for n, _, o in own}
        for n in ordinal:
            found = got[t, n]
            assert found.verdict == why_not(own, n)
            assert (found.depth, found["pass"]) == want.get(n, (None, None))
        whole = len(want) == len(own)
        order = sorted(want, key=lambda n: (want[n][1], ordinal[n], n))
        assert [got[t, n].position for n in order] == (list(range(len(order))) if whole else [None] * len(order))
    assert trees.ordered(nodes.limit(0), ordinal="ordinal").count() == 0


def test_one_path_of_many_nodes_stays_narrow(spark):
    """A path of 200,000 nodes, whose chains would hold 20 billion ids; every second step goes backward."""
    n = 200_000
    path = spark.range(n).selectExpr("7L as paper_id", "id as node", "case when id > 0 then id - 1 end as parent", "id % 2 as ordinal")
    got = trees.ordered(path, ordinal="ordinal").agg(F.max("depth").alias("d"), F.max("pass").alias("p"), F.countDistinct("position").alias("k"), F.max("position").alias("m")).first()
    assert tuple(got) == (n - 1, (n - 1) // 2, n, n - 1)
    flat = trees.flatten(path, max_depth=3).agg(F.max("depth").alias("d"), F.max("parent").alias("p"), F.count("*").alias("k")).first()
    assert tuple(flat) == (3, 2, n)


def walk(rows, budget, order):
    """First in, first out, in batches of what the budget leaves."""
    held = {(t, n) for t, n, *_ in rows}
    front = sorted((r for r in rows if r[2] is None or (r[0], r[2]) not in held), key=lambda r: (order[r[0]], r[1]))
    out, depth = [], 0
    while front and len(out) < budget:
        batch = front[: budget - len(out)]
        out += [(t, n, depth, len(out) + k + 1) for k, (t, n, *_) in enumerate(batch)]
        if any(r[4] for r in batch):
            break
        front, depth = [c for t, n, p, e, s in batch if e for c in sorted(r for r in rows if r[0] == t and r[2] == n)], depth + 1
    return out


def test_walks_match_a_queue(spark):
    rng = random.Random(5)
    for trial in range(4):
        rows = [(t, n, None if n == 0 else rng.randrange(-1, n) if rng.random() < 0.9 else 99, rng.random() < 0.8, rng.random() < 0.02 * trial) for t in range(4) for n in range(25)]
        order = {t: k for k, t in enumerate(rng.sample(range(4), 4))}
        nodes = spark.createDataFrame([(*r, order[r[0]]) for r in rows], "paper_id long, node long, parent long, expand boolean, sufficient boolean, pos int")
        for budget in (3, 17, 500):
            got = trees.expanded(nodes, budget, order=["pos", "node"]).collect()
            assert sorted((r.paper_id, r.node, r.depth, r.place) for r in got) == sorted(walk(rows, budget, order))
        apart = trees.expanded(nodes, 6, walk="paper_id").collect()
        assert sorted((r.paper_id, r.node, r.depth, r.place) for r in apart) == sorted(x for t in range(4) for x in walk([r for r in rows if r[0] == t], 6, order))
    assert Counter(r.stopped_reason for r in trees.stop_reasons(trees.expanded(nodes.limit(0), 3, walk="paper_id"), 3).collect()) == {}


def test_many_papers_of_one_title_take_linear_time():
    """Two papers for every DOI and id; each row would once have been held against all papers before it."""
    papers, n = identity._Papers(), 100_000
    row = {"source": "s", "title": "Editorial", "first_author": "Ann Lee", "published_at": "2020-01-01", "venue": None}
    began = time.perf_counter()
    home = [papers.place({**row, "position": k, "doi": f"10.1/{k // 2}" if k % 4 < 2 else None, "arxiv_id": f"2401.{k // 4}" if k % 4 else None})[0] for k in range(n)]
    assert time.perf_counter() - began < 60 and len(set(home)) < n
    assert home[0] == home[1] and home[2] == home[1]
