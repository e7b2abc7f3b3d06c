"""Incremental polling in batches: high-water marks and insert-if-new. `landing` has the same as a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import insert_ignore


def watermarks(items: DataFrame, marks: DataFrame, source: str = "source", time: str = "created_at") -> DataFrame:
    """The next mark of each source: its latest item, but never earlier than before."""
    seen = items.groupBy(source).agg(F.max(time).alias("latest"))
    return marks.join(seen, source, "full_outer").select(source, F.greatest("mark", "latest").alias("mark"))


def fresh(items: DataFrame, marks: DataFrame, source: str = "source", time: str = "created_at") -> DataFrame:
    """Items strictly later than the mark of their source; sources without a mark give all."""
    return items.join(marks, source, "left").where(F.col("mark").isNull() | (F.col(time) > F.col("mark"))).select(items.columns)


def poll(items: DataFrame, stored: DataFrame, marks: DataFrame, keys: list[str], time: str = "created_at") -> DataFrame:
    """What a poll inserts: fresh items whose key is new."""
    return insert_ignore(stored, fresh(items, marks, keys[0], time), keys, [F.asc(time)])


def poll_all(sources: dict[str, Callable[[], DataFrame] | None], marks: dict[str, datetime], clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> tuple[dict[str, DataFrame], dict[str, datetime], dict[str, str]]:
    """(items of each source, next marks, failures). The next mark of a source is the time at which its poll began, once that
    has succeeded, so what is posted meanwhile is polled again and known by its key. A source that fails keeps its mark, so that
    its window is polled again; one that is None is skipped, which is no failure. Counting a source's items makes it fail here and not later."""
    items, after, failed = {}, dict(marks), {}
    for name, read in sources.items():
        if read is None:
            continue
        try:
            began = clock()
            found = read()
            if name in marks:
                found = found.where(F.col("posted_at") > F.lit(marks[name]))
            found.count()
        except Exception as e:  # whatever goes wrong in one source
            failed[name] = str(e)
            continue
        items[name] = found
        after[name] = began
    return items, after, failed
