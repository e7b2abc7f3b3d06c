"""Scalar text functions as column expressions; Python only where the JVM has no equal."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def normalize_text(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def truncate_words(text: Column, n: int = 60) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def root_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


#: A number: digits with or without a fraction, or a fraction alone; then an exponent. A unit: one word.
_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
_QUANTITY = rf"^\s*({_NUMBER})\s*(\S+)?\s*$"


def parse_quantity(text: Column) -> Column:
    """struct(value, unit) of a number with an optional unit; nulls if the text is no such thing."""
    number, unit = (F.nullif(F.regexp_extract(text, _QUANTITY, k), F.lit("")) for k in (1, 2))
    return F.struct(number.try_cast("double").alias("value"), unit.alias("unit"))


def split_quantity(text: str) -> tuple[float | None, str | None]:
    """The same outside of a query."""
    found = re.match(_QUANTITY, text)
    return (float(found[1]), found[2]) if found else (None, None)


def normalize_quantity(value: Column, unit: Column) -> Column:
    """Percentages as fractions without a unit."""
    percent = F.lower(unit).isin("%", "percent", "percentage")
    return F.struct(F.when(percent, value / 100).otherwise(value).alias("value"), F.when(percent, F.lit("")).otherwise(F.coalesce(unit, F.lit(""))).alias("unit"))


def coords_pages(coords: Column) -> Column:
    """Page numbers of `page,x,y,..;page,x,y,..`; groups that begin with no number are left out."""
    return F.filter(F.transform(F.split(coords, ";"), lambda g: F.floor(F.split(g, ",")[0].try_cast("double")).cast("int")), lambda p: p.isNotNull())


def render_citation(title: Column, path: Column, first: Column, last: Column, doi: Column, arxiv: Column) -> Column:
    """`title — path — pages — DOI: x`, the DOI before the arXiv id; null without either."""
    pages = F.when(first.isNull(), "pages unavailable").when(last.isNull() | (first == last), F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string")))
    name = F.when(doi != "", F.concat(F.lit("DOI: "), doi)).when(arxiv != "", F.concat(F.lit("arXiv: "), arxiv))
    return F.when(name.isNotNull(), F.concat_ws(" — ", title, path, pages, name))


def paper_ref(doi: Column, arxiv: Column, paper_id: Column) -> Column:
    return F.when(doi != "", doi).when(arxiv != "", arxiv).otherwise(F.concat(F.lit("paper #"), paper_id.cast("string")))


def inverted_index_text(index: Column) -> Column:
    """The text of a map word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def attributed_ids(statement: Column) -> Column:
    """Node ids of a trailing `[node 1]` or `[nodes 1, 2]`."""
    inner = F.regexp_extract(statement, r"(?i)\[nodes?\s+(\d+(?:\s*,\s*\d+)*)\]\s*$", 1)
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(inner, r"\s*,\s*"), lambda x: x.cast("bigint")))


@F.udf(StringType(), useArrow=False)
def _plain_letters(title: str | None) -> str | None:
    """Row by row: rows cross in batches of a hundred, however long the texts are; in Arrow they are ten thousand."""
    return None if title is None else "".join(filter(str.isalnum, unicodedata.normalize("NFKC", title).casefold()))


def normalize_title(title: Column | str) -> Column:
    """NFKC, case folded, letters and digits only. ASCII texts, as long in bytes as in characters, don't leave the JVM."""
    title = F.col(title) if isinstance(title, str) else title
    ascii = F.octet_length(title) == F.char_length(title)
    return F.when(ascii, F.regexp_replace(F.lower(title), "[^0-9a-z]+", "")).otherwise(_plain_letters(F.when(~ascii, title)))


class Runs:
    """Suffix automaton of a row of words: the longest run that it shares with another, in one pass over that."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            now = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] > self.length[p] + 1:
                    copy = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[copy] = self.link[q]
                    self.link[q] = copy
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    q = copy
                self.link[now] = q
            last = now

    def _state(self, length: int, ways: dict[str, int]) -> int:
        self.next.append(ways)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def longest(self, words: list[str]) -> int:
        best = at = run = 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                run = self.length[at]
            if w in self.next[at]:
                at, run = self.next[at][w], run + 1
                best = max(best, run)
        return best


@F.pandas_udf(DoubleType())
def verbatim_overlap(claims: pd.Series, bodies: pd.Series) -> pd.Series:
    """Longest common run of tokens over the tokens of the claim."""
    known: dict[str, tuple[int, Runs]] = {}

    def one(claim: str | None, body: str | None) -> float:
        if not claim or not body:
            return 0.0
        if claim not in known:
            words = re.findall(r"\w+", claim.casefold())
            known[claim] = len(words), Runs(words)
        n, runs = known[claim]
        return runs.longest(re.findall(r"\w+", body.casefold())) / n if n else 0.0

    return pd.Series([one(c, b) for c, b in zip(claims, bodies, strict=True)])


@F.pandas_udf(StringType())
def verbatim_span(bodies: pd.Series, wanted: pd.Series) -> pd.Series:
    """The body's own text that equals the wanted one but for white space; null if there is none."""

    def one(body: str | None, text: str | None) -> str | None:
        words = (text or "").split()
        if not words or body is None:
            return None
        found = re.search(r"\s+".join(map(re.escape, words)), body)
        return found[0] if found else None

    return pd.Series([one(b, w) for b, w in zip(bodies, wanted, strict=True)])
