"""Text for people: tables in one line, citation markers, job names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single_line(text: Column, width: int = 80) -> Column:
    """White space collapsed, cut to the width with an ellipsis, padded."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.rpad(F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat), width, " ")


def job_name(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, r"[^A-Za-z0-9]", "_"))


def renumber(statement: Column, numbers: Column) -> Column:
    """A trailing `[nodes 7, 9]` as `[1][2]` by a map node id -> citation number; unknown nodes go."""
    pattern = r"(?i)\s*\[nodes?\s+(\d+(?:\s*,\s*\d+)*)\]\s*$"
    inner = F.regexp_extract(statement, pattern, 1)
    cited = F.filter(F.transform(F.split(inner, r"\s*,\s*"), lambda x: F.element_at(numbers, x.try_cast("bigint"))), lambda n: n.isNotNull())
    marks = F.array_join(F.transform(F.array_sort(F.array_distinct(cited)), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    return F.when(inner == "", statement).otherwise(F.concat_ws(" ", F.regexp_replace(statement, pattern, ""), F.nullif(marks, F.lit(""))))
