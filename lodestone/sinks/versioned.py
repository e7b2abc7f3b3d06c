"""A table whose changes are seen whole or not at all: folders of Parquet, and a manifest for each version.

Rows lie in buckets by a hash of the key. A change reads the buckets of its own rows, computes what
these hold afterwards with the operators of `history`, writes that to a new folder and then puts the
manifest of the next version in place, which fails if that version is there already. So a job that
dies before has changed nothing, whatever it wrote; readers stay with the version that they began
with. A writer that comes second goes on from the new version if the other one touched none of the
buckets that it has rewritten, else it ends with `Conflict` and nothing is changed.

A change may carry a name and a number: one whose number was applied under that name is not applied
again, so that jobs and streams can be repeated.

The driver handles names of buckets and folders alone; what it keeps doesn't grow with the rows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import history
from ..operators.scratch import drop, settle

#: Numbers of rows, of 8 bytes each, that may be broadcast.
FEW = 1_000_000

Change = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer has changed what this one has read."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 16) -> VersionedTable:
        """The table at this path; if there is none, an empty one."""
        made = cls(spark, path)
        if made.version() < 0:
            schema = spark.createDataFrame([], schema).schema
            first = {"version": 0, "schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "parts": {}, "applied": {}, "touched": [], "meta": {}, "operation": "create"}
            made._publish(first)  # whoever was faster has made the same
        return made

    # files

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _publish(self, manifest: dict) -> bool:
        """Put the manifest in place if its version is free. Its content is whole before it has its name."""
        draft, name = f"{self.path}/log/.draft-{uuid.uuid4().hex}", self._log(manifest["version"])
        out = self._fs.create(self._path(draft), True)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            return self._rename(draft, name)
        finally:
            self._fs.delete(self._path(draft), False)

    def _rename(self, draft: str, name: str) -> bool:
        """Atomic, and False if the name is taken."""
        jvm = self.spark._jvm
        if self._local:  # only the driver writes manifests; renaming local files would replace
            try:
                os.link(urlparse(draft).path, urlparse(name).path)
            except FileExistsError:
                return False
            return True
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(draft), self._path(name), options)
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        return True

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The latest; -1 if there is no table."""
        return max((int(n[:-5]) for n in self._names(f"{self.path}/log") if n.endswith(".json") and not n.startswith(".")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs.open(self._path(self._log(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # reading

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: files of others are not even listed."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        wanted = manifest["parts"] if buckets is None else {str(b): manifest["parts"].get(str(b), []) for b in buckets}
        folders = sorted(f"{self.path}/{f}" for parts in wanted.values() for f in parts)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, manifest: dict | None = None) -> Column:
        manifest = manifest or self.manifest()
        return F.pmod(F.xxhash64(*manifest["keys"]), F.lit(manifest["buckets"])).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Of rows with the key columns; no more than there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    # changing

    def _write(self, rows: DataFrame, manifest: dict, gather: bool = True) -> dict[str, list[str]]:
        """New folders by bucket. Rows of a bucket are gathered, those of a large one in several tasks, and sorted by key; or each task writes its own, in the order that they have."""
        folder = f"data/{uuid.uuid4().hex}"
        names = StructType.fromJson(manifest["schema"]).fieldNames()
        rows = rows.select(*names, self.bucket(manifest).alias("_bucket"))
        rows = rows.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", *manifest["keys"]) if gather else rows.sortWithinPartitions("_bucket")
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in self._names(f"{self.path}/{folder}") if n.startswith("_bucket=")}

    def _commit(self, base: dict, put: dict[str, list[str]], replaced: list[int] | None, operation: str, once: tuple[str, int] | None, meta: dict | None, seen: list[int] | None = None) -> int:
        """`replaced` are the buckets of which nothing but `put` stays; without any, `put` is added to what there is. `seen` were read, but stay."""
        touched = sorted({*(int(b) for b in put), *(replaced or [])})
        while True:
            parts = {b: f for b, f in base["parts"].items() if replaced is None or int(b) not in replaced}
            for b, folders in put.items():
                parts[b] = [*parts.get(b, []), *folders]
            applied = base["applied"] | ({once[0]: once[1]} if once else {})
            after = base | {"version": base["version"] + 1, "parts": parts, "applied": applied, "touched": touched, "meta": base["meta"] | (meta or {}), "operation": operation, "at": time.time()}
            if self._publish(after):
                return after["version"]
            base = self.manifest(base["version"] + 1)
            if self._applied(base, once):
                return base["version"]
            if {*(replaced or []), *(seen or [])} & set(base["touched"]):
                raise Conflict(f"version {base['version']} of {self.path} ({base['operation']}) changed buckets that this {operation} has read")

    @staticmethod
    def _applied(manifest: dict, once: tuple[str, int] | None) -> bool:
        return once is not None and manifest["applied"].get(once[0], -1) >= once[1]

    def append(self, rows: DataFrame, once: tuple[str, int] | None = None, meta: dict | None = None, gather: bool = True) -> int:
        """Add rows, whatever their keys; never conflicts. Returns the version. Without `gather` nothing is shuffled, and there are as many files as tasks and buckets."""
        base = self.manifest()
        return base["version"] if self._applied(base, once) else self._commit(base, self._write(rows, base, gather), None, "append", once, meta)

    def change(self, incoming: DataFrame, rule: Change, operation: str = "change", once: tuple[str, int] | None = None, meta: dict | None = None, whole: bool = False, add: bool = False) -> int:
        """Let `rule` make the new rows from the current ones and the incoming ones; it sees the buckets of the incoming rows, or the whole table.

        With `add` it makes further rows, and the current ones stay where they are.
        """
        base = self.manifest()
        if self._applied(base, once):
            return base["version"]
        kept = settle(incoming)
        try:
            touched = list(range(base["buckets"])) if whole else sorted(r[0] for r in kept.select(self.bucket(base).alias("b")).distinct().collect())
            if not touched and not meta:
                return base["version"]
            wrote = self._write(rule(self._rows(base, touched), kept), base)
            return self._commit(base, wrote, None if add else touched, operation, once, meta, seen=touched)
        finally:
            drop(kept)

    def _single(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with each key once; a repeated key is an error, as it doesn't say which of its rows counts."""
        n = F.count("*").over(history.Window.partitionBy(*keys))
        said = F.when(n > 1, F.raise_error(F.concat(F.lit("several rows for one key: "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
        return rows.withColumn("_single", said.cast("boolean")).where("_single").drop("_single")

    def upsert(self, rows: DataFrame, order: list[Column] | None = None, **more) -> int:
        """An incoming row takes the place of the row of its key; of several the first in the order."""
        keys = self.manifest()["keys"]
        rows = history.latest(rows, keys, order) if order else self._single(rows, keys)
        return self.change(rows, lambda old, new: history.upsert(old, new.select(old.columns), keys), "upsert", **more)

    def insert_ignore(self, rows: DataFrame, order: list[Column], **more) -> int:
        """Rows of new keys, the first of each in the order. What is there is neither read but for its keys nor written again."""
        keys, spent = self.manifest()["keys"], []

        def new_ones(old: DataFrame, new: DataFrame) -> DataFrame:
            # keys and order alone are shuffled; whole rows only if too many of them are left out for a broadcast of their numbers
            placed = new.select(*keys, "_n", F.row_number().over(history.Window.partitionBy(*keys).orderBy(*order)).alias("_place"))
            known = placed.where("_place = 1").join(old.select(*keys), keys, "left_semi").select("_n")
            out = settle(placed.where("_place > 1").select("_n").unionByName(known))
            spent.append(out)
            n = out.count()
            return new.join(F.broadcast(out) if n <= FEW else out, "_n", "left_anti") if n else new

        try:
            return self.change(rows.withColumn("_n", F.monotonically_increasing_id()), new_ones, "insert_ignore", add=True, **more)
        finally:
            for table in spent:
                drop(table)

    def replace(self, rows: DataFrame, **more) -> int:
        """All rows of each incoming key go, the incoming ones come."""
        keys = self.manifest()["keys"]
        return self.change(rows, lambda old, new: old.join(new.select(*keys).distinct(), keys, "left_anti").select(new.columns).unionByName(new).select(old.columns), "replace", **more)

    def delete(self, keys_of: DataFrame, **more) -> int:
        keys = self.manifest()["keys"]
        return self.change(keys_of, lambda old, gone: old.join(gone.select(*keys), keys, "left_anti").select(old.columns), "delete", **more)

    def reconcile(self, rows: DataFrame, **more) -> int:
        """The incoming rows are all there shall be."""
        return self.change(self._single(rows, self.manifest()["keys"]), lambda old, new: new.select(old.columns), "reconcile", whole=True, **more)

    def restore(self, version: int, meta: dict | None = None) -> int:
        """A new version with the rows of a former one."""
        base, then = self.manifest(), self.manifest(version)
        return self._commit(base, then["parts"], list(range(base["buckets"])), f"restore {version}", None, then["meta"] | (meta or {}))

    def vacuum(self, keep: int = 1, older_than: float = 7 * 86400) -> list[str]:
        """Delete folders that none of the last `keep` versions names and that no running job can be writing, as they are old."""
        last = self.version()
        named = {f.rpartition("/")[0] for v in range(max(0, last - keep + 1), last + 1) for parts in self.manifest(v)["parts"].values() for f in parts}
        gone = []
        for name in self._names(f"{self.path}/data"):
            path = self._path(f"{self.path}/data/{name}")
            if f"data/{name}" not in named and self._fs.getFileStatus(path).getModificationTime() / 1000 <= time.time() - older_than:
                self._fs.delete(path, True)
                gone.append(name)
        return gone


def migrate(ledger: VersionedTable, steps: list[tuple[str, Callable[[tuple[str, int]], None]]]) -> list[str]:
    """Run the steps that the ledger doesn't have, in order, each once; returns their names.

    A step gets a (name, number) for the changes that it makes, so that one which died between its
    change and its entry in the ledger changes nothing when it runs again. A ledger that is not a
    beginning of the steps is refused, as it belongs to other code.
    """
    names = [name for name, _ in steps]
    if len(set(names)) < len(names):
        raise ValueError("steps need different names")
    done = [r["name"] for r in ledger.read().orderBy("number").select("name").collect()]  # as many as there are steps
    if done != names[: len(done)]:
        raise ValueError(f"the ledger has {done}, which is no beginning of {names}")
    for number, (name, step) in enumerate(steps[len(done) :], len(done)):
        step((name, 0))
        row = ledger.spark.createDataFrame([(number, name)], "number int, name string").withColumn("applied_at", F.current_timestamp())
        ledger.insert_ignore(row, [F.asc("number")], once=("migrate", number))
    return names[len(done) :]


LEDGER = "number int, name string, applied_at timestamp"
