"""Hand-labelled questions and claims, and the rubric's version."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def gold_questions(spark: SparkSession, payload: dict) -> DataFrame:
    """(question, scope, path), one row a path, of a parsed gold set; errors name what is wrong."""
    if payload.get("version") != 1:
        raise ValueError("version")
    rows, seen = [], set()
    for item in payload.get("questions") or []:
        text, scope, paths = (item.get(k) for k in ("question", "scope", "section_paths"))
        if not (text or "").strip() or not (scope or "").strip() or not paths:
            raise ValueError(f"incomplete: {item}")
        if (scope, text) in seen:
            raise ValueError(f"repeated: {text}")
        seen.add((scope, text))
        rows += [(text, scope, p) for p in dict.fromkeys(paths)]
    return spark.createDataFrame(rows, "question string, scope string, path string")


def rubric_version(declared: str, content: str) -> str:
    """The declared version and the start of a digest of the whole text, so that edits show."""
    return f"{declared}-{hashlib.sha256(content.encode()).hexdigest()[:12]}"


def check_weights(weights: dict[str, int]) -> None:
    if sum(weights.values()) != 100:
        raise ValueError("weights must sum to 100")
