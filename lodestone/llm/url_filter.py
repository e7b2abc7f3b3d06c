"""URL rules by a sort-merge range join on reversed-host keys.

The key of a host is its labels in reverse, each followed by the lowest byte (which is escaped in
labels), so that the hosts under a rule's host are exactly the interval of keys that begin with the
rule's key. Rules and pages are dealt to the same key ranges (bounds are taken from the rules, at most
RANGES of them; a rule goes to every range its interval meets). A range is spread over one task for
each even share of all pages, SHARE at most, which are counted, and each gets the range's rules. Every task sweeps its rows
in key order with a stack of the hosts whose intervals are open. The paths of a host's rules are
intervals as well, nested by their prefixes: a page's path is looked up by bisection, and from there
goes out to the smallest interval that holds it. Of the rules found on the stack the longest (host and
path together) wins.

Cases: a null url or one without `://` has an empty host and path, fits no rule and gets the
default verdict, as does any page without a rule. Equal rules: the first in order of verdict, so
allow. Repeated rows give repeated results. Extra columns are ignored. Empty tables give no rows or
default verdicts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = 256
#: Most pages of one task of a range.
SHARE = 100_000
MARK = "\x01"
#: What stands in a key for the mark, and for the byte that begins it.
ESCAPES = [("\x02", "\x02\x03"), ("\x01", "\x02\x02")]

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """example.com -> com<mark>example<mark>; the empty host has the empty key."""
    plain = host
    for byte, code in ESCAPES:
        plain = F.replace(plain, F.lit(byte), F.lit(code))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), MARK), F.lit(MARK)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


class Paths:
    """The rules of one host by path, entered in order: intervals of paths, each with the one around it."""

    def __init__(self, host: str):
        self.host = host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.around: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        k = len(self.paths) - 1
        if k >= 0 and self.paths[k] == path:
            return  # of equal rules the first counts
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.around.append(k)

    def longest(self, path: str) -> int:
        """The rule with the longest beginning of a path, or -1."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return k


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, salt, key, with the rules of a key before its pages, in order of path."""
    where = None
    stack: list[tuple[str, Paths]] = []
    for batch in batches:
        at, out = [], []
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        names = ["part", "salt", "key", "kind", "host", "path", "verdict", "rule_host"]
        for i, (part, salt, key, kind, host, path, verdict, rule_host) in enumerate(zip(*(column[n].to_pylist() for n in names), strict=True)):
            if (part, salt) != where:
                where, stack = (part, salt), []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, Paths(rule_host)))
                stack[-1][1].add(path, verdict)
                continue
            best = (None, None)
            for _, rules in stack:
                if (k := rules.longest(path)) >= 0 and (best[0] is None or len(rules.host) + len(rules.paths[k]) > len(best[0])):
                    best = (rules.host + rules.paths[k], rules.verdicts[k])
            at.append(i)
            out.append((host, path, *best))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([column["page"].take(pa.array(at, pa.int64())), *(pa.array(list(c), pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int = RANGES) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of `pages`; `rules` as rule_table() makes them."""
    host, path = host_and_path(F.col(url_col))
    rules = rules.select("verdict", "rule_host", F.coalesce("rule_path", F.lit("")).alias("rule_path"), key_of(F.col("rule_host")).alias("key")).where("rule_host is not null and rule_host <> ''").distinct()
    # at most `ranges` bounds: evenly spaced keys of the rules
    few = F.percentile_approx(F.conv(F.substring(F.hex("key"), 1, 14), 16, 10).cast("long"), [k / ranges for k in range(1, ranges)])
    found = rules.agg(few).first()[0] or []
    bounds = sorted({bytes.fromhex(f"{b:x}".rjust(len(f"{b:x}") + len(f"{b:x}") % 2, "0")).decode(errors="ignore") for b in found})
    marks = F.array(*[F.lit(b) for b in bounds]).cast("array<string>")
    below = lambda key: F.size(F.filter(marks, lambda b: b <= key))
    spark = pages.sparkSession
    ranged = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path")).withColumn("key", key_of(F.col("host"))).withColumn("part", below(F.col("key")))
    # at most `ranges` + 1 counts
    held = dict(ranged.groupBy("part").count().collect())
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, min(SHARE, sum(held.values()) // wide))
    tasks = {part: -(-n // share) for part, n in held.items()}
    salts = F.get(F.array(*[F.lit(tasks.get(k, 1)) for k in range(len(bounds) + 1)]), F.col("part"))
    right = ranged.select("part", F.pmod(F.monotonically_increasing_id(), salts).cast("int").alias("salt"), "key", F.lit(1).alias("kind"), "page", "host", "path", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule_host"))
    kind = pages.schema[id_col].dataType.simpleString()
    # the interval of a rule ends before the key with its last mark raised
    last = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(chr(ord(MARK) + 1)))
    left = rules.withColumn("part", F.explode(F.sequence(below(F.col("key")), below(last)))).withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    left = left.select("part", "salt", "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page"), F.lit(None).cast("string").alias("host"), F.col("rule_path").alias("path"), "verdict", "rule_host")
    rows = left.unionByName(right).repartition(max(wide, sum(tasks.values())), "part", "salt").sortWithinPartitions("part", "salt", "key", "kind", "path", "verdict")
    judged = rows.mapInArrow(_sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
