"""Commits of the versioned table: whole or not at all, once each, and without lost changes."""

import pytest
from pyspark.sql import functions as F

from lodestone.sinks.versioned import LEDGER, Conflict, VersionedTable, migrate

ROWS = "k long, v string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "t"), ROWS, ["k"], buckets=8)


def put(spark, *rows):
    return spark.createDataFrame(rows, ROWS)


def rows(table, version=None):
    return sorted(((r["k"], r["v"]) for r in table.read(version).collect()), key=repr)


def test_merges(spark, table):
    assert rows(table) == []
    table.upsert(put(spark, (1, "a"), (2, "b"), (None, "n")))
    table.upsert(put(spark, (2, "c"), (3, "d")))
    table.insert_ignore(put(spark, (3, "no"), (4, "y"), (4, "x")), [F.asc("v")])
    assert rows(table) == [(1, "a"), (2, "c"), (3, "d"), (4, "x"), (None, "n")]
    table.replace(put(spark, (1, "p"), (1, "q")))
    table.delete(put(spark, (2, "")))
    assert rows(table) == [(1, "p"), (1, "q"), (3, "d"), (4, "x"), (None, "n")]
    table.append(put(spark, (4, "x")))
    assert rows(table).count((4, "x")) == 2
    version = table.version()
    table.reconcile(put(spark, (9, "z")))
    assert rows(table) == [(9, "z")] and len(rows(table, version)) == 6  # readers of a former version keep it
    table.restore(version)
    assert len(rows(table)) == 6
    with pytest.raises(Exception, match="several rows for one key"):
        table.upsert(put(spark, (1, "a"), (1, "b")))
    table.upsert(put(spark, (1, "a"), (1, "b")), order=[F.desc("v")])
    assert [r for r in rows(table) if r[0] == 1] == [(1, "b")]


def test_merges_rewrite_touched_buckets_only(spark, table):
    table.append(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    before = table.manifest()["parts"]
    table.upsert(put(spark, (5, "b")))
    after = table.manifest()["parts"]
    changed = [b for b in before if before[b] != after[b]]
    assert changed == [str(b) for b in table.buckets_of(put(spark, (5, "")))] and len(rows(table)) == 200


def test_a_killed_write_changes_nothing_and_is_swept(spark, table):
    table.upsert(put(spark, (1, "a")))

    def die(old, new):
        return old.unionByName(new).withColumn("v", F.raise_error(F.lit("killed")).cast("string"))

    with pytest.raises(Exception, match="killed"):
        table.change(put(spark, (1, "b")), die)
    wrote = table._write(put(spark, (1, "c")), table.manifest())  # dies before the manifest
    assert wrote and rows(table) == [(1, "a")]
    assert table.vacuum(older_than=3600) == [] and len(table.vacuum(keep=1, older_than=-60)) >= 1
    assert rows(table) == [(1, "a")]


def race(table, other):
    """Let `other` commit between this writer's reading and its own commit."""
    write = table._write

    def late(*a):
        wrote = write(*a)
        table._write = write
        other()
        return wrote

    table._write = late


def test_writers_of_one_bucket_conflict(spark, table):
    table.upsert(put(spark, (1, "a")))
    other = VersionedTable(spark, table.path)
    race(table, lambda: other.upsert(put(spark, (1, "theirs"))))
    with pytest.raises(Conflict):
        table.upsert(put(spark, (1, "mine")))
    assert rows(table) == [(1, "theirs")]
    table.upsert(put(spark, (1, "mine")))
    assert rows(table) == [(1, "mine")]


def test_writers_of_other_buckets_and_appends_do_not(spark, table):
    far = next(k for k in range(2, 50) if table.buckets_of(put(spark, (k, ""))) != table.buckets_of(put(spark, (1, ""))))
    other = VersionedTable(spark, table.path)
    race(table, lambda: other.upsert(put(spark, (far, "theirs"))))
    table.upsert(put(spark, (1, "mine")))
    race(table, lambda: other.upsert(put(spark, (1, "again"))))
    table.append(put(spark, (1, "more")))
    assert rows(table) == sorted([(1, "again"), (1, "more"), (far, "theirs")])


def test_changes_are_applied_once(spark, table):
    for k in (0, 0, 1, 0):
        table.append(put(spark, (k, "x")), once=("job", k))
    assert rows(table) == [(0, "x"), (1, "x")] and table.version() == 2
    other = VersionedTable(spark, table.path)
    race(table, lambda: other.append(put(spark, (2, "x")), once=("job", 2)))
    table.append(put(spark, (2, "x")), once=("job", 2))
    assert rows(table) == [(0, "x"), (1, "x"), (2, "x")]


def test_names_of_versions_are_taken_once_by_any_file_system(spark, table):
    table._local = False  # the way of shared file systems
    table.append(put(spark, (1, "a")))
    assert table._publish(table.manifest()) is False and rows(table) == [(1, "a")]


def test_migrations_run_once_in_order(spark, tmp_path, table):
    ledger = VersionedTable.create(spark, str(tmp_path / "ledger"), LEDGER, ["number"])
    ran = []

    def step(name, k, dies=False):
        def run(once):
            ran.append(name)
            table.append(put(spark, (k, name)), once=once)
            if dies and ran.count(name) == 1:
                raise RuntimeError("lost after the change")

        return name, run

    one, two, three = step("one", 1), step("two", 2, dies=True), step("three", 3)
    assert migrate(ledger, [one]) == ["one"] and migrate(ledger, [one]) == []
    with pytest.raises(RuntimeError):
        migrate(ledger, [one, two, three])
    assert migrate(ledger, [one, two, three]) == ["two", "three"]
    assert ran == ["one", "two", "two", "three"] and rows(table) == [(1, "one"), (2, "two"), (3, "three")]
    for bad in ([two, one], [one], [one, one]):
        with pytest.raises(ValueError):
            migrate(ledger, bad)
