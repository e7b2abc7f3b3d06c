"""Polls as a streaming source: payloads land as files, a folder for each source, and are read once each.

Fetching is none of the engine's business: whoever polls a community writes what came back, a payload
a line, as a file in the folder of its source, under a name later than those before it (the time of
the poll, say). An offset of the stream is a mark for each source, the name of the last file that was
read; so restarts go on where each source had come to. A source whose folder can't be listed keeps
its mark and the others go on.

What is read is written once for each key, however late an item comes and however long ago its key
was seen: a batch meets the rows of the target's buckets that its own keys fall into, and a batch
that is repeated after a failure is known by its number.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sinks.versioned import VersionedTable
from ..sources import feeds

#: Files that one task reads; bytes of payloads that it hands on at a time.
FILES, BYTES = 8, 4 << 20


class LandedPolls(DataSource):
    """Options: path, and marks, a folder in which the marks are kept too, for sources that can't be listed after a restart."""

    @classmethod
    def name(cls) -> str:
        return "landed_polls"

    def schema(self) -> str:
        return "source string, file string, payload string"

    def streamReader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], self.options.get("marks"))


class Files(InputPartition):
    def __init__(self, source: str, paths: list[str]):
        self.source, self.paths = source, paths


class LandedReader(DataSourceStreamReader):
    def __init__(self, path: str, marks: str | None = None):
        self.path, self.marks = path.rstrip("/"), marks and f"{marks.rstrip('/')}/marks.json"
        self.known: dict[str, str] = {}

    def _list(self, folder: str, kind: fs.FileType) -> list[str]:
        where, path = fs.FileSystem.from_uri(folder)
        return sorted(i.base_name for i in where.get_file_info(fs.FileSelector(path)) if i.type == kind and not i.base_name.startswith(("_", ".")))

    def _saved(self) -> dict[str, str]:
        if self.marks:
            where, path = fs.FileSystem.from_uri(self.marks)
            if where.get_file_info(path).type == fs.FileType.File:
                with where.open_input_file(path) as f:
                    return json.loads(f.read())
        return {}

    def _save(self, marks: dict[str, str]) -> None:
        """Spark has logged the end of a batch before it asks for its partitions, so it will be read whatever happens."""
        before = {**self._saved(), **self.known}
        self.known = {**before, **{s: max(m, before.get(s, "")) for s, m in marks.items()}}
        if self.marks and self.known != before:
            where, path = fs.FileSystem.from_uri(self.marks)
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(path) as f:
                f.write(json.dumps(self.known).encode())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        latest = {**self._saved(), **self.known}
        for source in self._list(self.path, fs.FileType.Directory):
            try:
                names = self._list(f"{self.path}/{source}", fs.FileType.File)
            except OSError:
                continue
            if names:
                latest[source] = max(names[-1], latest.get(source, ""))
        return latest

    def partitions(self, start: dict, end: dict) -> list[Files]:
        found = []
        for source, last in end.items():
            if last > start.get(source, ""):
                names = [n for n in self._list(f"{self.path}/{source}", fs.FileType.File) if start.get(source, "") < n <= last]
                found += [Files(source, [f"{self.path}/{source}/{n}" for n in names[k : k + FILES]]) for k in range(0, len(names), FILES)]
        self._save({**start, **end})
        return found

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        def batch(file: str, lines: list[str]) -> pa.RecordBatch:
            n, source = len(lines), partition.source.rpartition("=")[2]
            return pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array([file] * n), pa.array(lines, pa.string())], names=["source", "file", "payload"])

        for file in partition.paths:
            where, path = fs.FileSystem.from_uri(file)
            lines, size = [], 0
            with where.open_input_stream(path) as stream:
                for line in io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", newline="\n"):
                    if line.strip():
                        lines.append(line.rstrip("\n"))
                        size += len(line)
                    if size > BYTES:
                        yield batch(file, lines)
                        lines, size = [], 0
            if lines:
                yield batch(file, lines)


#: How the payloads of a source are read: (frame with value) -> items.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hackernews": feeds.hacker_news_lists,
    "reddit": feeds.reddit,
    "hf_daily": feeds.daily_papers,
    "rss": feeds.rss_payloads,
}


def items(payloads: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] = PARSERS) -> DataFrame:
    """The items of payloads (source, payload), batch or stream; sources without a parser give none."""
    parts = [parse(payloads.where(F.col("source") == name).select(F.col("payload").alias("value"))) for name, parse in parsers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest(stream: DataFrame, table: VersionedTable, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Write each new key of the table once, in one run over what has arrived; of one key's rows in a batch the first by time counts."""

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.dropna(subset=table.manifest()["keys"])
        table.insert_ignore(keyed, [F.asc_nulls_last("posted_at"), F.asc_nulls_last("url"), F.asc_nulls_last("title")], once=(name, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str, marks: str | None = None) -> DataFrame:
    """The payloads as a stream."""
    spark.dataSource.register(LandedPolls)
    reader = spark.readStream.format("landed_polls").option("path", path)
    return (reader.option("marks", marks) if marks else reader).load()
