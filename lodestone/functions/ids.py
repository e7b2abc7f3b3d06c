"""Paper identifiers: normal forms and extraction from free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_title

#: An identifier of the present scheme is year, month and a running number; one of the old scheme
#: names its archive, perhaps with a subject class, before year, month and three digits.
_YEAR_MONTH = r"\d\d(?:0[1-9]|1[0-2])"
_DATED = rf"(?<!\d)({_YEAR_MONTH}\.\d{{4,5}})(?!\d)"
_ARCHIVED = rf"(?i)(?<![\w.-])([a-z]+(?:-[a-z]+)*(?:\.[a-z]{{2}})?/{_YEAR_MONTH}\d{{3}})(?!\d)"
#: A DOI is a registrant's prefix, which may have parts, and a suffix of its own making; in prose it ends
#: at a blank or a bracket of markup, and the punctuation of the sentence doesn't belong to it.
_DOI = r"(?<![\d.])(10\.\d{4,}(?:\.\d+)*/[^\s<>\"{}]+)"
_PROSE_END = r"[.,;)\]]+$"


def normalize_doi(doi: Column, resolver: bool = True) -> Column:
    """Without its prefix; `resolver` takes the old name of the resolver, dx.doi.org, for one as well, as papers' identity doesn't."""
    prefix = r"^(https?://(dx\.)?doi\.org/|doi:)" if resolver else r"^(https?://doi\.org/|doi:)"
    bare = F.regexp_replace(F.lower(F.trim(doi)), prefix, "")
    return F.nullif(F.trim(bare) if resolver else bare, F.lit(""))


def normalize_arxiv(arxiv: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(arxiv)), r"^arxiv:", ""), r"v\d+$", ""), F.lit(""))


def _found(text: Column, pattern: str, kind: str, plain: Callable[[Column], Column]) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), plain(x).alias("value")))


def extract_identifiers(text: Column) -> Column:
    """Distinct struct(kind, value) in order: new arXiv ids, old ones, DOIs."""
    dois = _found(text, _DOI, "doi", lambda x: normalize_doi(F.regexp_replace(x, _PROSE_END, "")))
    every = F.concat(_found(text, _DATED, "arxiv", normalize_arxiv), _found(text, _ARCHIVED, "arxiv", normalize_arxiv), dois)
    return F.array_distinct(F.filter(every, lambda s: s["value"].isNotNull()))


def surname(author: Column) -> Column:
    """Before the comma, or else the last word; letters and digits only."""
    last = F.when(F.contains(author, F.lit(",")), F.split_part(author, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1))
    return normalize_title(last)


def title_author_year(title: Column, first_author: Column, published: Column) -> Column:
    """Key of papers without identifiers; null if a part is missing."""
    plain, last = normalize_title(title), surname(first_author)
    return F.when((plain != "") & (last != "") & published.isNotNull(), F.concat_ws("|", plain, last, F.year(published).cast("string")))
