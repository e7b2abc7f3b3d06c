"""A positional inverted index as a table: postings of (lexeme, paper, unit, positions) in buckets by lexeme.

A refresh compares the digests of the units with those it knows and reads the texts of changed ones
only; their postings are added as a segment, with a mark (under the empty lexeme) that ends the
postings of former segments of the same unit. So an update never rewrites a bucket, and a question
reads the buckets of its lexemes, and the marks, whatever the size of the corpus. `compact` folds the
segments into one.

The postings are committed before the digests. If a job dies in between, the next refresh first takes
back what no digest knows of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.versioned import FEW, VersionedTable
from . import search
from .scratch import drop, settle

#: The lexeme of the marks; no word is empty.
MARK = ""


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, paper_type: str = "long"):
        self.spark, path = spark, path.rstrip("/")
        ids = f"paper {paper_type}, unit long"
        self.table = VersionedTable.create(spark, f"{path}/postings", f"lexeme string, {ids}, segment int, positions array<int>", ["lexeme"], buckets)
        self.units = VersionedTable.create(spark, f"{path}/units", f"{ids}, digest string, live boolean", ["paper", "unit"], buckets)

    def refresh(self, units: DataFrame, complete: bool = False) -> int:
        """Take in units (paper, unit, body) that are new or have changed; returns how many. `complete` says that others are gone."""
        known = self.units.manifest()
        postings, segment = known["meta"].get("postings", 0), known["meta"].get("segment", 0) + 1
        if self.table.version() != postings:
            postings = self.table.restore(postings)
        ids, now = ["paper", "unit"], units.select("paper", "unit", F.coalesce("body", F.lit("")).alias("body")).withColumn("digest", F.md5("body"))
        old = self.units.read(known["version"]).where("live").select(*ids, F.col("digest").alias("before"))
        # ids and digests alone meet; texts are shuffled only if too many of them are as before for a broadcast of their ids
        same = settle(now.select(*ids, "digest").join(old, ids).where("digest = before").select(*ids)) if known["parts"] else None
        k = same.count() if same is not None else 0
        new = (now.join(F.broadcast(same) if k <= FEW else same, ids, "left_anti") if k else now).withColumn("live", F.lit(True))
        if complete:
            gone = old.join(now.select(*ids), ids, "left_anti")
            new = new.unionByName(gone.select(*ids, F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("digest"), F.lit(False).alias("live")))
        changed = settle(new)
        try:
            n = changed.count()
            if not n:
                return 0
            marks = changed.select(*ids).join(old, ids, "left_semi").select(F.lit(MARK).alias("lexeme"), *ids, F.lit(None).cast("array<int>").alias("positions"))
            rows = search.postings(changed.where("live")).select("lexeme", *ids, "positions").unionByName(marks).withColumn("segment", F.lit(segment))
            version = self.table.append(rows, meta={"segments": segment}, gather=False)
            self.units.upsert(changed.select(*ids, F.coalesce("digest", F.lit("")).alias("digest"), "live"), meta={"postings": version, "segment": segment})
            return n
        finally:
            drop(changed)
            if same is not None:
                drop(same)

    def _live(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        ends = marks.groupBy(F.col("paper").alias("p"), F.col("unit").alias("u")).agg(F.max("segment").alias("ended"))
        return rows.join(ends, (F.col("paper") == F.col("p")) & (F.col("unit") == F.col("u")) & (F.col("segment") < F.col("ended")), "left_anti")

    def postings(self, lexemes: list[str] | None = None) -> DataFrame:
        """(lexeme, paper, unit, positions) of the present units, of all lexemes or of some, whose buckets alone are read."""
        buckets = lambda names: self.table.buckets_of(self.spark.createDataFrame([(x,) for x in names], "lexeme string")) if names is not None else None
        version = self.table.version()
        rows = self.table.read(version, buckets(lexemes)).where(F.col("lexeme") != MARK if lexemes is None else F.col("lexeme").isin(lexemes))
        marks = self.table.read(version, buckets([MARK])).where(F.col("lexeme") == MARK)
        return self._live(rows, marks).select("lexeme", "paper", "unit", "positions")

    def frequencies(self, lexemes: list[str] | None = None) -> DataFrame:
        """(lexeme, units): in how many units a lexeme stands."""
        return self.postings(lexemes).groupBy("lexeme").agg(F.count("*").alias("units"))

    def shortlist(self, question: str, limit: int, paper: str = "paper_id", scope: str | None = None, paper_scopes: DataFrame | None = None) -> DataFrame:
        """As `search.shortlist` on the units that the index has."""
        asked = search.checked(question, limit, scope, paper_scopes)
        universe = search.in_scope(self.units.read().where("live").select("paper", "unit"), scope, paper_scopes, paper)
        if not asked.alternatives:
            return search.best_papers(universe.select("paper", F.lit(0).cast("long").alias("billionths")).where(F.lit(False)), limit, paper)
        found = search.in_scope(self.postings(asked.lexemes), scope, paper_scopes, paper).withColumn("pos", F.explode("positions")).drop("positions")
        return search.best_papers(search.ranked_units(found, asked, universe), limit, paper)

    def compact(self) -> int:
        """One segment without marks; questions give the same rows."""
        segment = self.units.manifest()["meta"].get("segment", 0)
        rows = settle(self.postings().withColumn("segment", F.lit(segment)))
        version = self.table.change(rows, lambda old, new: new.select(old.columns), "compact", whole=True, meta={"segments": segment})
        none = self.units.read().limit(0)
        self.units.change(none, lambda old, new: old, "compact", meta={"postings": version})
        drop(rows)
        return version
