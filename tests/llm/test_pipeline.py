"""The pipeline's stages on a small corpus: what each keeps, and what comes out at the end."""

import random

import corpus_pipeline
from tests.llm.test_operators import words


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    stock = "the of and river house garden winter paper letter window music doctor summer village bridge market teacher morning kitchen story engine forest island mountain silver yellow quiet simple between under because".split()
    return " ".join(rng.choice(stock) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    item = prose(1, 30)
    clean = [(k, prose(100 + k)) for k in range(6)]
    copy = clean[2][1].split()
    copy[60] = "otherwise"
    passage = prose(50, 60)
    rows = [*clean, (10, "too short"), (11, "again " * 80), (12, None), (13, clean[1][1]), (14, " ".join(copy)), (15, f"{item} {prose(9, 40)}"), (16, f"{prose(60)} {passage} {prose(61)}"), (17, f"{prose(62)} {passage} {prose(63)}"), (13, clean[1][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == sorted([*range(6), 13, 13, 14, 15, 16, 17])
    assert kept[1] == kept[2] == [*range(6), 15, 16, 17]
    assert kept[3] == [*range(6), 16, 17]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[0] == clean[0][1] and passage not in texts[16] and texts[16].startswith(prose(60)) and texts[17].endswith(prose(63))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and sum(r.length for r in packed) > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert words(1, 2) == words(1, 2)


def test_near_copies_with_repeated_and_null_ids(spark, tmp_path):
    """A row is dropped for its own text only, and rows without an id are judged as well."""
    texts = [prose(200 + k) for k in range(5)]
    copy = texts[0].split()
    copy[60] = "otherwise"
    near = texts[1].split()
    near[30] = "elsewhere"
    rows = [(1, texts[0]), (2, " ".join(copy)), (2, texts[2]), (None, texts[1]), (None, " ".join(near)), (None, texts[0]), (None, texts[3]), (4, texts[4]), (4, texts[4]), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    pair = [x for x in got if x in [(None, texts[1]), (None, " ".join(near))]]
    assert len(pair) == 1
    rest = [x for x in got if x not in pair]
    assert sorted(rest, key=repr) == sorted([(1, texts[0]), (2, texts[2]), (None, texts[3]), (4, texts[4]), (5, None), (None, None)], key=repr)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
