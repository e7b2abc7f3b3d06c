"""Polls as a stream: marks for each source, restarts, sources that fail, keys written once whenever they come."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sinks.versioned import VersionedTable
from lodestone.sources.feeds import ITEM
from lodestone.streaming import landing


class Polls:
    def __init__(self, spark, tmp):
        self.spark, self.tmp = spark, tmp
        self.table = VersionedTable.create(spark, str(tmp / "items"), ITEM, ["source", "external_id"], buckets=4)

    def land(self, source, name, *payloads):
        folder = self.tmp / "landing" / source
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("".join(f"{p if isinstance(p, str) else json.dumps(p)}\n" for p in payloads))

    def run(self):
        stream = landing.items(landing.landed(self.spark, str(self.tmp / "landing"), str(self.tmp / "marks")))
        query = landing.ingest(stream, self.table, str(self.tmp / "checkpoint"))
        assert query.awaitTermination(120)
        return sorted((r["source"], r["external_id"], r["title"]) for r in self.table.read().collect())

    def marks(self):
        return json.loads((self.tmp / "marks" / "marks.json").read_text())


@pytest.fixture
def polls(spark, tmp_path):
    return Polls(spark, tmp_path)


def story(i, title, time=1_700_000_000):
    return {"id": i, "type": "story", "title": title, "by": "a", "time": time, "score": 3, "descendants": 1}


def post(i, title):
    return {"data": {"children": [{"data": {"id": i, "permalink": f"/r/{i}", "title": title, "author": "b", "selftext": "t", "created_utc": 1.7e9, "score": 1, "num_comments": 0}}]}}


FEED = '<rss version="2.0"><channel><title>f</title><item><guid>g{0}</guid><link>http://x/{0}</link><title> T{0} </title><description>a &lt;b&gt; c</description><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item><item><link>http://x/only</link><title>no guid</title></item></channel></rss>'


def test_all_parsers_then_a_restart_reads_only_what_is_new(polls):
    polls.land("hackernews", "2024-01-01", [story(1, "one"), {"id": 2, "type": "comment"}, story(3, "three")])
    polls.land("reddit", "2024-01-01", post("r1", "red"))
    polls.land("hf_daily", "2024-01-01", [{"publishedAt": "2024-01-02T00:00:00Z", "title": "paper", "paper": {"id": "2401.1", "summary": "s", "upvotes": 2}}])
    polls.land("rss", "2024-01-01", FEED.format(1))
    polls.land("unknown", "2024-01-01", {"x": 1})
    first = [("hackernews", "1", "one"), ("hackernews", "3", "three"), ("hf_daily", "2401.1", "paper"), ("reddit", "r1", "red"), ("rss", "g1", "T1"), ("rss", "http://x/only", "no guid")]
    assert polls.run() == first
    body = polls.table.read().where("external_id = 'g1'").first()
    assert body.body == "a <b> c" and body.posted_at.day == 5
    version = polls.table.version()
    assert polls.run() == first and polls.table.version() == version  # nothing new, nothing read
    os.replace(polls.tmp / "landing/reddit/2024-01-01", polls.tmp / "gone")  # what was read isn't asked for again
    polls.land("reddit", "2024-01-02", post("r2", "blue"))
    assert polls.run() == sorted([*first, ("reddit", "r2", "blue")])
    assert polls.marks() == {s: "2024-01-01" for s in ("hackernews", "hf_daily", "rss", "unknown")} | {"reddit": "2024-01-02"}


def test_keys_are_written_once_and_late_items_are_written(polls):
    day = 86_400
    polls.land("hackernews", "01", [story(1, "first", 1_700_000_000)])
    polls.run()
    polls.land("hackernews", "02", [story(1, "again", 1_700_000_000 + 10 * day), story(2, "new", 1_700_000_000 + 10 * day)])
    polls.run()
    polls.land("hackernews", "03", [story(3, "late by a year", 1_700_000_000 - 365 * day), story(2, "again"), story(1, "again")], [story(3, "later in the poll", 1_700_000_000 - 364 * day)])
    assert polls.run() == [("hackernews", "1", "first"), ("hackernews", "2", "new"), ("hackernews", "3", "late by a year")]


def test_payloads_that_do_not_parse_and_rows_without_keys_are_left_out(polls):
    polls.land("hackernews", "01", "no json", "[]", [story(None, "no id"), story(4, "good")])
    polls.land("rss", "01", "<broken", FEED.format(2))
    assert polls.run() == [("hackernews", "4", "good"), ("rss", "g2", "T2"), ("rss", "http://x/only", "no guid")]


def test_a_source_that_cannot_be_listed_keeps_its_mark(tmp_path):
    for source in ("a", "b"):
        (tmp_path / source).mkdir()
        (tmp_path / source / "1").write_text("x\n")
    reader = landing.LandedReader(str(tmp_path), str(tmp_path / "_marks"))
    end = reader.latestOffset()
    assert end == {"a": "1", "b": "1"} and sorted(p.source for p in reader.partitions({}, end)) == ["a", "b"]
    (tmp_path / "a" / "2").write_text("y\n")
    (tmp_path / "b" / "2").write_text("y\n")
    again = landing.LandedReader(str(tmp_path), str(tmp_path / "_marks"))  # after a restart
    listed = again._list

    def failing(folder, kind):
        if folder.endswith("/b"):
            raise OSError("no answer")
        return listed(folder, kind)

    again._list = failing
    later = again.latestOffset()
    assert later == {"a": "2", "b": "1"} and [(p.source, [x[-1] for x in p.paths]) for p in again.partitions(end, later)] == [("a", ["2"])]
    again._list = listed
    assert again.latestOffset() == {"a": "2", "b": "2"}
    assert [p.source for p in again.partitions(later, again.latestOffset())] == ["b"]


def test_a_batch_that_is_repeated_is_known(spark, polls):
    batch = spark.createDataFrame([("s", "1", None, "t", None, None, None, 1, 1)], ITEM)
    for _ in range(2):
        polls.table.insert_ignore(batch, [F.asc("url")], once=("ingest", 0))
    assert polls.table.version() == 1
