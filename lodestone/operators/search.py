"""Full-text shortlist without embeddings: English lexemes, web search questions, cover density.

A unit is a section, or a paper's title and abstract together; a paper ranks by its best unit. Where a
unit satisfies one of the question's alternatives, its rank is the cover density: each smallest
stretch of words that satisfies an alternative gives 0.1 / (1 + words in it that aren't the
question's). Negated phrases are judged on the whole unit. Shares are counted in whole billionths, so
that the order in which they are added up can't change a rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.english import Numbers, Stems, surely_in, words
from ..functions.websearch import Question, parse

#: One cover without other words in it has the rank 0.1.
WHOLE = 1_000_000_000
#: A word, as `english.words` finds them.
WORD = r"[\p{L}\p{N}]+(?:_+[\p{L}\p{N}]+)*"
#: Characters of the texts of which postings are emitted at a time.
SLICE = 4 << 20


def as_units(sections: DataFrame, papers: DataFrame | None = None, paper: str = "paper_id", body: str = "body", unit: str | None = None) -> DataFrame:
    """(paper, unit, body): sections by their `unit` column, or else numbered as they come; titles with abstracts as unit -1."""
    rows = sections.select(F.col(paper).alias("paper"), (F.col(unit) if unit else F.monotonically_increasing_id()).cast("long").alias("unit"), F.col(body).alias("body"))
    if papers is None:
        return rows
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract") if c in papers.columns]
    heads = papers.select(F.col(paper).alias("paper"), F.lit(-1).cast("long").alias("unit"), F.concat_ws(" ", *parts).alias("body"))
    return rows.join(heads.select("paper").distinct(), "paper", "left_semi").unionByName(heads)


#: What a Python worker remembers, from task to task.
_numbers = Numbers()


def _postings_of(batch: pa.RecordBatch, start: int, texts: list[str | None]) -> pa.RecordBatch:
    _numbers.trim()
    said = [words(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, said), np.int64, len(said))
    codes = np.fromiter(map(_numbers.__getitem__, chain.from_iterable(said)), np.int32, sizes.sum())
    rows, places = np.repeat(np.arange(len(said)), sizes), np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # by lexeme; texts and places stay in order, as the sort is stable
    order = np.flatnonzero(codes >= 0)
    order = order[np.argsort(codes[order], kind="stable")]
    codes, rows, places = codes[order], rows[order], places[order]
    starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0))
    kinds, at = np.unique(codes[starts], return_inverse=True)
    names = pa.array([_numbers.names[k] for k in kinds.tolist()], pa.string()).take(pa.array(at))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(places, pa.int32()))
    own = pa.array(start + rows[starts])
    return pa.RecordBatch.from_arrays([batch.column("paper").take(own), batch.column("unit").take(own), names, lists], names=["paper", "unit", "lexeme", "positions"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, start, size = batch.column("body").to_pylist(), 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text or "")
            if size > SLICE or k == len(texts):
                yield _postings_of(batch, start, texts[start:k])
                start, size = k, 0


def postings(units: DataFrame) -> DataFrame:
    """(paper, unit, lexeme, positions) of units (paper, unit, body). Tasks read their own texts only; the rows of a lexeme come together within SLICE."""
    types = {f.name: f.dataType.simpleString() for f in units.schema}
    return units.select("paper", "unit", "body").mapInArrow(_postings, f"paper {types['paper']}, unit {types['unit']}, lexeme string, positions array<int>")


_memo = Stems()


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(_memo.__getitem__)


def entries(units: DataFrame, wanted: list[str]) -> DataFrame:
    """(paper, unit, lexeme, pos) of the wanted lexemes in units (paper, unit, body). Only words that begin like one of them leave the JVM."""
    words = F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0))
    starts = sorted({surely_in(x) for x in wanted})
    near = F.filter(F.transform(words, lambda w, k: F.struct(w.alias("word"), (k + 1).alias("pos"))), lambda x: reduce(or_, [F.startswith(x["word"], F.lit(s)) for s in starts]))
    each = units.select("paper", "unit", F.explode(near).alias("x")).select("paper", "unit", "x.pos", _stems(F.col("x.word")).alias("lexeme"))
    return each.where(F.col("lexeme").isin(wanted))


def likely(question: Question, body: Column) -> Column:
    """A plain test that no matching text fails: it holds how the words of an alternative begin."""
    low = F.lower(body)
    needs = [[surely_in(lexeme) for p in a if not p.negated for lexeme, _ in p.terms] for a in question.alternatives]
    return reduce(or_, [reduce(and_, [F.contains(low, F.lit(x)) for x in need], F.lit(True)) for need in needs], F.lit(False))


def ranked_units(found: DataFrame, question: Question, universe: DataFrame | None = None) -> DataFrame:
    """(paper, unit, billionths) of the units that match; `found` has the entries (paper, unit, lexeme, pos) of the question's lexemes.

    `universe` (paper, unit) is only read for alternatives that are nothing but negations. Units meet
    by (paper, unit) once; nothing is joined but that universe.
    """
    phrases = question.phrases
    number = {p.terms: k for k, p in enumerate(phrases)}
    unit = ["paper", "unit"]
    places: dict[str, list[tuple[int, int, int]]] = {}
    for k, p in enumerate(phrases):
        for i, (lexeme, after) in enumerate(p.terms):
            places.setdefault(lexeme, []).append((k, i, after))
    entry = lambda x: F.struct(F.lit(x[0]).alias("k"), F.lit(x[1]).alias("i"), F.lit(x[2]).alias("after"))
    roles = F.create_map(*[y for lexeme, xs in places.items() for y in (F.lit(lexeme), F.array(*[entry(x) for x in xs]))])
    # entries with their number among those of the unit, then the phrases that they may be part of
    placed = found.withColumn("nth", F.dense_rank().over(Window.partitionBy(*unit).orderBy("pos")))
    parts = placed.select(*unit, "pos", "nth", F.explode(roles[F.col("lexeme")]).alias("x")).select(*unit, "pos", "nth", "x.k", "x.i", (F.col("pos") - F.col("x.after")).alias("start"))
    last = F.array(*[F.lit(len(p.terms) - 1) for p in phrases])[F.col("k")]
    whole = parts.groupBy(*unit, "k", "start").agg(F.count("*").alias("n"), F.max("pos").alias("end"), F.min("nth").alias("from_nth"), F.max("nth").alias("to_nth"))
    occurrences = whole.where(F.col("n") == last + 1).withColumn("present", F.collect_set("k").over(Window.partitionBy(*unit)))
    # the latest start of each phrase that has ended by here, and from these the smallest stretch of each alternative
    so_far = Window.partitionBy(*unit).orderBy("end")
    starts = [F.max(F.when(F.col("k") == k, F.struct("start", "from_nth"))).over(so_far) for k in range(len(phrases))]
    here = occurrences.select(*unit, "present", "end", "to_nth", *[s.alias(f"s{k}") for k, s in enumerate(starts)])

    def stretch(alternative) -> Column | None:
        needs = [number[p.terms] for p in alternative if not p.negated]
        bans = [number[p.terms] for p in alternative if p.negated]
        if not needs:
            return None
        allowed = reduce(and_, [F.col(f"s{k}").isNotNull() for k in needs] + [~F.array_contains("present", k) for k in bans])
        return F.when(allowed, F.least(*[F.col(f"s{k}") for k in needs]) if len(needs) > 1 else F.col(f"s{needs[0]}"))

    stretches = [s for a in question.alternatives if (s := stretch(a)) is not None]
    matched = None
    if stretches:
        best = F.greatest(*stretches) if len(stretches) > 1 else stretches[0]
        covers = here.withColumn("from", best).where(F.col("from").isNotNull()).groupBy(*unit, "from").agg(F.min(F.struct("end", "to_nth")).alias("to"))
        others = (F.col("to.end") - F.col("from.start")) - (F.col("to.to_nth") - F.col("from.from_nth"))
        matched = covers.groupBy(*unit).agg(F.sum(F.floor(F.lit(WHOLE) / (1 + others))).cast("long").alias("billionths"))
    for bans in [[number[p.terms] for p in a] for a in question.alternatives if all(p.negated for p in a)]:
        spared = universe.select(*unit).join(occurrences.where(F.col("k").isin(bans)).select(*unit).distinct(), unit, "left_anti").withColumn("billionths", F.lit(0).cast("long"))
        matched = spared if matched is None else matched.unionByName(spared)
    return matched


def best_papers(ranked: DataFrame, limit: int, paper: str = "paper_id") -> DataFrame:
    """(paper, rank) by the best unit, ties by id."""
    best = ranked.groupBy("paper").agg((F.max("billionths") / (10 * WHOLE)).alias("rank"))
    return best.orderBy(F.desc("rank"), F.asc("paper")).limit(limit).withColumnRenamed("paper", paper)


def checked(question: str, limit: int, scope: str | None, paper_scopes: DataFrame | None) -> Question:
    if not question.strip() or limit < 1:
        raise ValueError("a question and a positive limit are needed")
    if (scope is None) != (paper_scopes is None) or scope is not None and not scope.strip():
        raise ValueError("a scope needs a name and the scopes of the papers")
    return parse(question)


def in_scope(rows: DataFrame, scope: str | None, paper_scopes: DataFrame | None, paper: str) -> DataFrame:
    if scope is None:
        return rows
    inside = paper_scopes.where(F.col("scope_name") == scope).select(F.col(paper).alias("paper")).distinct()
    return rows.join(inside, "paper", "left_semi")


def shortlist(
    sections: DataFrame, question: str, limit: int, paper: str = "paper_id", body: str = "body", papers: DataFrame | None = None, scope: str | None = None, paper_scopes: DataFrame | None = None
) -> DataFrame:
    """(paper, rank) of the papers that match by a section, or by title and abstract, straight from the texts.

    `papers` (paper, title and, if there is one, abstract) is what can come back; without it, sections alone are searched.
    `scope` keeps the papers that `paper_scopes` (paper, scope_name) has in it. A question without lexemes matches nothing.
    The limit is the feature. For many questions on one corpus, `SearchIndex` reads the words of each only.
    """
    asked = checked(question, limit, scope, paper_scopes)
    units = in_scope(as_units(sections, papers, paper, body), scope, paper_scopes, paper)
    if not asked.alternatives:
        return best_papers(units.select("paper", F.lit(0).cast("long").alias("billionths")).where(F.lit(False)), limit, paper)
    return best_papers(ranked_units(entries(units.where(likely(asked, F.col("body"))), asked.lexemes), asked, units), limit, paper)


def word_shortlist(sections: DataFrame, words: list[str], limit: int, paper: str = "paper_id", body: str = "body") -> DataFrame:
    """(paper, rank) of the papers that have all words in one section, by the most places of them in one section, then id.

    Words are taken as they stand, in any case: there are no stems, and stop words count like others, so a list of
    these finds papers where a question, which has no lexemes then, finds none. Edges are those of `\\b` over ASCII.
    """
    wanted = sorted({w.lower() for w in words if w.strip()})
    if not wanted or limit < 1:
        raise ValueError("at least one word and a positive limit are needed")
    low, edge = F.lower(F.col(body)), "[0-9A-Za-z_]"
    counts = F.array(*[F.regexp_count(low, F.lit(f"(?<!{edge}){re.escape(w)}(?!{edge})")) for w in wanted])
    # a plain substring test drops most texts before any pattern runs
    near = sections.where(reduce(and_, [F.contains(low, F.lit(w)) for w in wanted])).select(paper, counts.alias("counts"))
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    return near.where(F.array_min("counts") > 0).groupBy(paper).agg(F.max(total).cast("long").alias("rank")).orderBy(F.desc("rank"), F.asc(paper)).limit(limit)
