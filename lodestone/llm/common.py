"""What the corpus operators share: table access, shared scratch space, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python; very long texts make small batches.
BATCH_ROWS, BATCH_BYTES = "512", "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    try:
        table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def small_batches(spark: SparkSession) -> None:
    """Keep what one Python worker holds small, whatever the lengths of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (tests on one machine) a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete materialised tables that nothing will read again, and let go of finished shuffles.

    Spark deletes the files of a shuffle once the driver's garbage collector has met it.
    """
    for df in tables:
        jvm, path = df.sparkSession._jvm, getattr(df, "lodestone_path", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    if tables and shuffles:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; a memo that is emptied when it grows too large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], memo: WordHashes, size: int) -> np.ndarray:
    """64-bit hashes of all `size`-word shingles in order; of fewer words, one of the whole."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(memo.__getitem__, words)), dtype=np.uint64)
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, 0x9E3779B97F4A7C15 + n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k])
    return out


def slices(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items whose sizes sum to about `budget`."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
