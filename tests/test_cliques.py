"""Canonical groups: the rule in rounds against the rule in order, on graphs of all kinds."""

import random

import pytest

from lodestone.operators import identity
from lodestone.operators.cliques import canonical_groups

PAIRS = "left_id long, right_id long, extra string"


def in_order(pairs):
    """Every merge looks at all pairs across."""
    accepted = {(min(p), max(p)) for p in pairs if None not in p and p[0] != p[1]}
    group = {x: frozenset([x]) for p in accepted for x in p}
    for a, b in sorted(accepted):
        one, two = group[a], group[b]
        if one != two and all((min(x, y), max(x, y)) in accepted for x in one for y in two):
            for x in one | two:
                group[x] = one | two
    return sorted((min(g), x) for x, g in group.items() if len(g) > 1)


def graph(kind, seed):
    rng = random.Random(seed)
    if kind == "sparse":
        return [(rng.randrange(80), rng.randrange(80)) for _ in range(150)]
    if kind == "dense":
        return [(a, b) for a in range(24) for b in range(a) if rng.random() < 0.8]
    if kind == "intervals":  # ranges that overlap, ids in no order of theirs
        at = [rng.random() * 30 for _ in range(70)]
        return [(a, b) for a in range(70) for b in range(a) if abs(at[a] - at[b]) < 1]
    if kind == "cliques":
        home = [rng.randrange(6) for _ in range(50)]
        return [(a, b) for a in range(50) for b in range(a) if home[a] == home[b] or rng.random() < 0.05]
    return [(k, k + 1) for k in range(12)]  # a chain in its own order


@pytest.mark.parametrize("kind,task_pairs", [("dense", 60), ("intervals", 10**6), ("cliques", 30), ("chain", 8)])
def test_groups_equal_the_rule_in_order(spark, kind, task_pairs):
    """Bounds of a task at which components of each kind need rounds first, and one at which none does; 0 to 10 were tried as well."""
    pairs = graph(kind, seed=task_pairs + 1)
    pairs += [p[::-1] for p in pairs[:9]] + [(5, 5), (None, 3), (4, None)]
    got = canonical_groups(spark.createDataFrame([(*p, "e") for p in pairs], PAIRS).repartition(3), task_pairs)
    assert sorted((r["canonical_id"], r["claim_id"]) for r in got.collect()) == in_order(pairs)


def test_no_pairs(spark):
    assert canonical_groups(spark.createDataFrame([], PAIRS)).collect() == []


def test_a_large_block_of_equal_claims_needs_no_task_of_its_own(spark):
    """1,000 claims, 499,500 pairs; none of the rounds hands a component to a task."""
    n = spark.range(1000).selectExpr("id as left_id").crossJoin(spark.range(1000).selectExpr("id as right_id")).where("left_id < right_id")
    got = canonical_groups(n, task_pairs=1)
    assert {(r["canonical_id"], r["claim_id"]) for r in got.collect()} == {(0, k) for k in range(1000)}


def priced(seed, n=90):
    """Items with few values, some far apart; one id has two values, others none or no block."""
    rng = random.Random(seed)
    rows = [(k, rng.choice("ab"), rng.choice([0.0, -10.0, 10.0, 10.4, 10.9, 11.3, 12.0, 14.0, 90.0])) for k in rng.sample(range(500), n)]
    return [*rows, (rows[0][0], rows[0][1], 12.5), (901, None, 10.0), (902, "a", None)]


def near(rows):
    """Each two rows against each other."""
    return [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] is not None and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 0.05 * (abs(a[2]) + abs(b[2]))]


def test_pairs_of_a_large_block_are_dealt(spark, monkeypatch):
    """the pairs of a block and value came from one task. Chunks of 4 here, and tasks of 50 pairs."""
    monkeypatch.setattr(identity, "CHUNK", 4)
    monkeypatch.setattr(identity, "TASK_PAIRS", 50)
    rows = priced(3)
    items = spark.createDataFrame(rows, "id long, block string, v double")
    got = identity.prefilter_pairs(items, ["block"], "id", "v")
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == sorted(near(rows))
    some = {r[0] for r in rows if r[0] % 4 == 0}
    got = identity.prefilter_pairs(items, ["block"], "id", "v", pending=spark.createDataFrame([(x,) for x in some] * 2, "id long"))
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == sorted(p for p in near(rows) if some & set(p))


def test_chunks_too_far_apart_are_not_compared(spark, monkeypatch):
    """all items of neighbour cells were compared, and all pairs of two chunks were held at once. With tasks of 50 pairs, their number tells how many are compared."""
    monkeypatch.setattr(identity, "TASK_PAIRS", 50)
    rows = [(k, "a", v + k / 1e6) for k, v in [*((k, 903.2) for k in range(40)), *((k, 1100.0) for k in range(40, 80))]]
    got = identity.prefilter_pairs(spark.createDataFrame(rows, "id long, block string, v double"), ["block"], "id", "v")
    assert got.rdd.getNumPartitions() <= 66  # 2 x 1600 pairs, and a task for those to check; 97 for 4800 before
    assert "Coalesce" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == sorted(near(rows))


#: Within the tolerance, by their SQL too, though the logarithms of both put them two cells apart.
EDGE = [(901, "c", 121754.82264005663), (902, "c", 134571.11976006257)]


@pytest.mark.parametrize("chunk", [3, 512])
def test_pairs_of_spread_values(spark, monkeypatch, chunk):
    """chunks that agree as a whole, in part, or not at all; values just at the edge of a cell were lost to one beyond the next."""
    monkeypatch.setattr(identity, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(k, rng.choice("ab"), rng.choice([-1, 1]) * rng.uniform(50, 90)) for k in range(150)]
    items = spark.createDataFrame([*rows, *EDGE], "id long, block string, v double")
    got = identity.prefilter_pairs(items, ["block"], "id", "v")
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == sorted([*near(rows), (901, 902)])
    some = {r[0] for r in rows if r[0] % 5 == 0}
    got = identity.prefilter_pairs(items, ["block"], "id", "v", pending=spark.createDataFrame([(x,) for x in some], "id long"))
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == sorted(p for p in near(rows) if some & set(p))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_items_whose_copies_have_no_pairs(spark, seed):
    """all pairs of copies were made. Here 90 items have fewer than 20 blocks and values."""
    rows = priced(seed)
    items = spark.createDataFrame(rows, "id long, block string, v double")
    twins = identity.equal_items(items, ["block"], "id", "v").localCheckpoint()
    assert twins.count() > 60
    pairs = identity.prefilter_pairs(items.join(twins, "id", "left_anti"), ["block"], "id", "v")
    got = canonical_groups(pairs, twins=twins)
    assert sorted((r["canonical_id"], r["claim_id"]) for r in got.collect()) == in_order(near(rows))
    # copies that nothing else is near are a group without any pair
    alone = spark.createDataFrame([(7, 9)], "into long, id long")
    assert sorted(tuple(r) for r in canonical_groups(spark.createDataFrame([], PAIRS), twins=alone).collect()) == [(7, 7), (7, 9)]
