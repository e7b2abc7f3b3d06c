"""Stems, questions, cover density against a slow plain version, and the index against searching the texts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.english import DERIVED, DERIVED_AGAIN, DROPPED, lexemes, stem, surely_in
from lodestone.functions.websearch import parse
from lodestone.operators import search
from lodestone.operators.search_index import MARK, SearchIndex

UNITS = "paper long, unit long, body string"
STEMS = """consign consigned:consign consignment:consign consistently:consist consolatory:consolatori consoled:consol conspiracy:conspiraci conspirators:conspir constables:constabl knackeries:knackeri knaves:knave kneeled:kneel
  knightly:knight knives:knive knocker:knocker codes:code generalization:general universities:univers happy:happi hoping:hope hopping:hop ties:tie cries:cri by say relational:relat electricity:electr decoders:decod surface:surfac
  agreed:agre feed youth boyish communication:communic generously:generous apologize:apolog geology:geolog formative:format adoption:adopt controlling:control gas gaps:gap dies:die luxuriated:luxuri filing:file possibly:possibl
  sensibility:sensibl owed:owe skies:sky early:earli news proceed inning kiwis:kiwi y is yes:yes sayings:say"""


def test_stems():
    for pair in STEMS.split():
        word, _, want = pair.partition(":")
        assert stem(word) == (want or word)
        assert word.startswith(surely_in(stem(word)))
    assert lexemes("The Codes, of noise_x2 and 7 don't") == [("code", 2), ("noise_x2", 4), ("7", 6)]


def test_stems_keep_how_words_begin():
    rng, ends = random.Random(1), [*DERIVED, *DERIVED_AGAIN, *DROPPED, *"s es ies ied ing ingly ed edly y ly e eed iness bility ability ibly".split()]
    for _ in range(20_000):
        word = "".join(rng.choice("abcdeilmnorstuyz") for _ in range(rng.randrange(1, 6))) + "".join(rng.choice(ends) for _ in range(rng.randrange(3)))
        assert word.startswith(surely_in(stem(word))), word


def shown(question):
    return [[("-" if p.negated else "") + " ".join(f"{lexeme}+{k}" for lexeme, k in p.terms) for p in a] for a in parse(question).alternatives]


@pytest.mark.parametrize(
    "question,want",
    [
        ("quantum codes", [["quantum+0", "code+0"]]), ('"exact phrases" noise', [["exact+0 phrase+1", "nois+0"]]), ("surface or decoder -noise", [["surfac+0"], ["decod+0", "-nois+0"]]), ('-"cat in the hat"', [["-cat+0 hat+3"]]),
        ("surface-code", [["surfac+0 code+1"]]), ("the of", []), ("or OR x or", [["x+0"]]), ('"open end', [["open+0 end+1"]]), ("x x X", [["x+0"]]), ("-- - ''", []), ("The QUANTUM", [["quantum+0"]]), ('a "b c', [["b+0 c+1"]]),
    ],
)
def test_questions(question, want):
    assert shown(question) == want


def plain(units, question, limit=1000):
    """(paper, billionths): every stretch of every unit is tried."""
    asked, best = parse(question), {}
    for paper, _, body in units:
        placed = {k: x for x, k in lexemes(body or "")}
        has = lambda p, lo, hi: any(all(lo <= at + k <= hi and placed.get(at + k) == x for x, k in p.terms) for at in placed)
        everywhere = (1, 10**9)
        alive = [a for a in asked.alternatives if not any(has(p, *everywhere) for p in a if p.negated) and all(has(p, *everywhere) for p in a if not p.negated)]
        if not alive:
            continue
        own = sorted(k for k, x in placed.items() if x in asked.lexemes)
        fits = {(lo, hi) for i, lo in enumerate(own) for hi in own[i:] if any(all(has(p, lo, hi) for p in a if not p.negated) for a in alive if not all(p.negated for p in a))}
        least = [(lo, hi) for lo, hi in fits if not any((a, b) != (lo, hi) and lo <= a and b <= hi for a, b in fits)]
        rank = sum(search.WHOLE // (1 + hi - lo - (sum(lo <= k <= hi for k in own) - 1)) for lo, hi in least)
        best[paper] = max(best.get(paper, 0), rank)
    return sorted(((p, r / (10 * search.WHOLE)) for p, r in best.items()), key=lambda x: (-x[1], x[0]))[:limit]


def random_units(seed, papers=25):
    rng = random.Random(seed)
    vocabulary = ["code", "codes", "coding", "surface", "noise", "noisy", "the", "of", "decoder", "threshold", "x7", "straße", "other", "words"]
    return [(p, u, None if rng.random() < 0.05 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for p in range(papers) for u in range(rng.randrange(4))]


QUESTIONS = [
    "code", "surface codes", '"surface code"', "code -noise", "-code", '-"surface code" decoder', "surface or decoder", '"code of surface" or "noisy decoder" threshold', "code or -noise", "code code surface threshold",
    '"code code"', '"code the code" surface', "surface-code or x7", "straße", "absent or absent2", '"decoder" "noise of" -"x7 x7"',
]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_trying_every_stretch(spark, seed):
    units = random_units(seed)
    frame = spark.createDataFrame(units, UNITS).repartition(3)
    for question in QUESTIONS:
        asked = parse(question)
        got = search.best_papers(search.ranked_units(search.entries(frame.where(search.likely(asked, F.col("body"))), asked.lexemes), asked, frame), 1000, "paper")
        assert [(r["paper"], r["rank"]) for r in got.collect()] == plain(units, question), question


def test_titles_abstracts_sections_and_scopes(spark):
    papers = spark.createDataFrame([(1, "Surface code threshold", "We estimate it."), (2, "A survey", "Neural decoders of codes."), (3, "Gates", None)], "paper_id long, title string, abstract string")
    sections = spark.createDataFrame([(3, "A transversal CNOT gate."), (3, "Nothing."), (1, "The CNOT of others, not transversal."), (9, "transversal CNOT")], "paper_id long, body string")
    scopes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "b")], "paper_id long, scope_name string")
    ask = lambda q, scope="a", limit=20: [r[0] for r in search.shortlist(sections, q, limit, papers=papers, scope=scope, paper_scopes=scopes).collect()]
    assert ask("surface code threshold") == [1] and ask("neural decoder") == [2] and ask("transversal CNOT") == [3, 1] and ask("transversal CNOT", "b") == [3]
    assert ask("transversal CNOT", limit=1) == [3] and ask("survey estimate") == [] and ask("gates -nothing") == [3] and ask("the") == []
    for bad in (("", "a"), ("x", " ")):
        with pytest.raises(ValueError):
            ask(*bad)
    with pytest.raises(ValueError):
        ask("x", limit=0)


def contents(index):
    return sorted((r["lexeme"], r["paper"], r["unit"], tuple(r["positions"])) for r in index.postings().collect())


def test_index_equals_the_texts_and_a_rebuild(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=8)
    first, rng = random_units(3), random.Random(4)
    frame = lambda rows: spark.createDataFrame(rows, UNITS)
    assert index.refresh(frame(first)) == len(first) and index.refresh(frame(first)) == 0
    changed = {(p, u): f"{b or ''} codes of noise" for p, u, b in first if rng.random() < 0.2}
    second = [(p, u, changed.get((p, u), b)) for p, u, b in first if p != 7] + [(99, 0, "surface code")]
    assert index.refresh(frame([r for r in second if (r[0], r[1]) in changed or r[0] == 99])) == len([r for r in second if (r[0], r[1]) in changed]) + 1
    assert index.refresh(frame(second), complete=True) == len([r for r in first if r[0] == 7])  # those that are gone
    fresh = SearchIndex(spark, str(tmp_path / "fresh"), buckets=8)
    fresh.refresh(frame(second))
    assert contents(index) == contents(fresh)
    for question in QUESTIONS:
        assert [tuple(r) for r in index.shortlist(question, 1000).collect()] == plain(second, question), question
    before = contents(index)
    index.compact()
    assert contents(index) == before and index.table.read().where(F.col("lexeme") == MARK).count() == 0 and index.refresh(frame(second)) == 0
    df = {r["lexeme"]: r["units"] for r in index.frequencies(["code", "surfac"]).collect()}
    assert df["code"] == sum("code" in {x for x, _ in lexemes(b or "")} for _, _, b in second)


def test_a_question_reads_the_buckets_of_its_lexemes(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=32)
    index.refresh(spark.createDataFrame(random_units(5), UNITS))
    wanted = index.table.buckets_of(spark.createDataFrame([("code",), ("surfac",)], "lexeme string"))
    read = {f.split("_bucket=")[1].split("/")[0] for f in index.postings(["code", "surfac"]).inputFiles()}
    assert {int(b) for b in read} <= {*wanted, *index.table.buckets_of(spark.createDataFrame([(MARK,)], "lexeme string"))} and len(read) < 8


def test_a_refresh_that_died_is_taken_back(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    index.refresh(spark.createDataFrame([(1, 0, "surface code")], UNITS))

    def die(*a, **b):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(index.units, "upsert", die)
        index.refresh(spark.createDataFrame([(1, 0, "noise"), (2, 0, "code code")], UNITS))
    assert index.refresh(spark.createDataFrame([(1, 0, "noise of codes")], UNITS)) == 1
    assert contents(index) == [("code", 1, 0, (3,)), ("nois", 1, 0, (1,))]


def test_word_shortlist_counts_stop_words(spark):
    """as a question, "the of" has no lexemes and found no paper at all."""
    rows = [(1, 0, "The end of the road"), (1, 1, "of"), (2, 0, "the other, of these"), (3, 0, "the"), (3, 1, "of"), (4, 0, "OF-THE of_the theof"), (5, 0, None)]
    got = search.word_shortlist(spark.createDataFrame([(p, b) for p, _, b in rows], "paper_id long, body string"), ["the", "of"], limit=2)
    assert [tuple(r) for r in got.collect()] == [(1, 3), (2, 2)]


def test_postings_of_a_lexeme_come_together(spark):
    """postings came text by text, so that a task had to sort them by lexeme."""
    rows = [(p, u, b) for p, u, b in random_units(6) + [(50, 0, ""), (51, 0, "the of"), (52, 0, "Noise_x2 7 the CODES codes")]]
    got = [(r["lexeme"], r["paper"], r["unit"], r["positions"]) for r in search.postings(spark.createDataFrame(rows, UNITS).coalesce(1)).collect()]
    want = {(x, p, u): [k for y, k in lexemes(b or "") if y == x] for p, u, b in rows for x, _ in lexemes(b or "")}
    assert {r[:3]: r[3] for r in got} == want and len(got) == len(want)
    runs = [r[0] for k, r in enumerate(got) if not k or got[k - 1][0] != r[0]]
    assert len(runs) == len(set(runs))


def test_a_refresh_shuffles_no_texts(spark, tmp_path, monkeypatch):
    """the texts themselves met the known digests once these were too many for a broadcast."""
    from lodestone.operators import search_index

    plans, inner = [], search_index.settle
    monkeypatch.setattr(search_index, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index, rows = SearchIndex(spark, str(tmp_path / "index"), buckets=2), [(p, 0, f"surface code {p}") for p in range(6)]
        index.refresh(spark.createDataFrame(rows, UNITS))
        assert index.refresh(spark.createDataFrame([*rows[:3], *((p, 0, "noise") for p in range(3, 8))], UNITS)) == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not any("SortMergeJoin" in p and "body" in p.split("SortMergeJoin")[0] for p in plans)
    assert {r["paper"] for r in index.postings(["nois"]).collect()} == set(range(3, 8)) and {r["paper"] for r in index.postings(["code"]).collect()} == {0, 1, 2}
