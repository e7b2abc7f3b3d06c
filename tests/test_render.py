"""Rendering, digests and gold sets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import render
from lodestone.operators.scoring import CONFIDENCE_POINTS, QUALITY_POINTS
from lodestone.plans import digest
from lodestone.sources import gold


def test_lines_and_markers(spark):
    df = spark.createDataFrame([("So it is. [nodes 9, 7, 5]", {7: 1, 9: 2}), ("No mark", {7: 1}), ("Gone [node 3]", {7: 1})], "s string, m map<bigint,int>")
    assert [r.x for r in df.select(render.renumber(F.col("s"), F.col("m")).alias("x")).collect()] == ["So it is. [1][2]", "No mark", "Gone"]
    r = spark.range(1).select(render.single_line(F.lit("a \n b"), 6).alias("a"), render.single_line(F.lit("abcdefgh"), 4).alias("b"), render.job_name(F.lit("claim-identity")).alias("c")).first()
    assert tuple(r) == ("a b   ", "abc…", "CLAIM_IDENTITY")


def test_digest_keeps_evidence_and_community_apart(spark):
    since = datetime(2024, 1, 1)
    quiet = digest.render(since, {})
    assert quiet.count(digest.NOTHING) == 2
    text = digest.render(since, {"new_evidence": spark.createDataFrame([(2, 7)], "claim_id long, evidence_id long"), "mentions": spark.createDataFrame([(1,)], "paper_id long")})
    evidence, community = text.split("## Community")
    assert "claim_id 2, evidence_id 7" in evidence and "paper_id 1" in community and "paper_id" not in evidence


def test_gold_sets_and_rubrics(spark):
    q = {"question": "q", "scope": "s", "section_paths": ["a", "b", "a"]}
    assert gold.gold_questions(spark, {"version": 1, "questions": [q]}).count() == 2
    for bad in ({"version": 2}, {"version": 1, "questions": [q, q]}, {"version": 1, "questions": [{**q, "section_paths": []}]}):
        with pytest.raises(ValueError):
            gold.gold_questions(spark, bad)
    assert gold.rubric_version("2", "x") != gold.rubric_version("2", "y") and gold.rubric_version("2", "x").startswith("2-")
    gold.check_weights(CONFIDENCE_POINTS)
    gold.check_weights(QUALITY_POINTS)
    with pytest.raises(ValueError):
        gold.check_weights({"a": 99})
