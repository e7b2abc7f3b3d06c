"""Cases worked out by hand."""

import ast
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, text
from lodestone.operators import changes, cliques, evaluate, history, identity, scoring, search, trees, validation
from lodestone.sources import feeds, papers, tei
from lodestone.streaming import poll

PAPER = "position long, source string, title string, first_author string, published_at string, doi string, arxiv_id string, venue string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def merged(spark, rows):
    got = identity.resolve_entities(spark.createDataFrame(rows, PAPER)).collect()
    return {r.position: r.entity_id for r in got}


def test_papers_merge_by_doi_arxiv_and_title(spark):
    rows = [
        (1, "arxiv", "A", "X", "2020-01-01", "10.1/ABC", None, None), (2, "openalex", "B", "Y", "2021-01-01", "https://doi.org/10.1/abc", None, None), (3, "arxiv", "C", None, None, None, "2401.01234v1", None),
        (4, "s2", "D", None, None, None, "arXiv:2401.01234v2", None), (5, "arxiv", "Attention Is All You Need", "Ashish Vaswani", "2017-06-12", None, None, None), (6, "s2", "attention is all you need!", "Vaswani, Ashish", "2017-01-01", None, None, None),
        (7, "s2", "Attention Is Not All You Need", "Ashish Vaswani", "2017-06-12", None, None, None), (8, "arxiv", "Same", "Z Z", "2020-01-01", "10.1/one", None, None), (9, "s2", "Same", "Z Z", "2020-01-01", "10.1/two", None, None),
    ]
    assert merged(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}


def test_a_merged_paper_matches_by_what_it_has_gained(spark):
    rows = [(1, "arxiv", "Long title", None, "2020-01-01", "10.1/a", None, None), (2, "s2", "", "Ann Lee", None, "10.1/a", None, None), (3, "openalex", "Long Title", "Lee, Ann", "2020-05-05", None, None, "V")]
    assert set(merged(spark, rows).values()) == {1}


def test_pairs_and_cliques(spark):
    values = spark.createDataFrame([(1, "t", 0.94), (2, "t", 1.0), (3, "t", 1.06), (4, "u", 1.0), (5, "t", None), (6, "t", -1.0), (7, "t", 0.0), (8, "t", 0.0)], "id long, block string, v double")
    pairs = identity.prefilter_pairs(values, ["block"], "id", "v")
    assert sorted((r.left_id, r.right_id) for r in pairs.collect()) == [(1, 2), (2, 3), (7, 8)]
    groups = cliques.canonical_groups(pairs).collect()
    assert sorted((r.canonical_id, r.claim_id) for r in groups) == [(1, 1), (1, 2), (7, 7), (7, 8)]


@pytest.mark.parametrize(("raw", "value", "unit"), [("1%", 1.0, "%"), ("0.01", 0.01, None), ("1e-2", 0.01, None), ("about 3", None, None), (" 5 ms ", 5.0, "ms"), ("", None, None), (None, None, None)])
def test_quantities(spark, raw, value, unit):
    x = one(spark, text.parse_quantity(F.lit(raw).cast("string")))
    assert (x.value, x.unit) == (value, unit)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("https://arxiv.org/abs/2601.01234", [("arxiv", "2601.01234")]), ("https://arxiv.org/pdf/quant-ph/0601001.pdf", [("arxiv", "quant-ph/0601001")]),
        ("see 2601.01234 and arXiv:1706.03762v5", [("arxiv", "2601.01234"), ("arxiv", "1706.03762")]), ("https://doi.org/10.1038/s41586-023-00001-x", [("doi", "10.1038/s41586-023-00001-x")]), ("", []),
        ("month 2413.01234, run 12401.01234 and 2401.012345", []), ("(hep-th/9901001v2), math.GT/0309136.", [("arxiv", "hep-th/9901001"), ("arxiv", "math.gt/0309136")]),
        ("<a href=\"https://dx.doi.org/10.1000.10/A(1)b\">x</a>; DOI:10.1002/x.y).", [("doi", "10.1000.10/a(1)b"), ("doi", "10.1002/x.y")]), ("110.1000/x 10.99/y hep-th/9913001", []),
    ],
)
def test_identifiers(spark, body, want):
    assert [tuple(x) for x in one(spark, ids.extract_identifiers(F.lit(body)))] == want


def test_verbatim_span_keeps_the_text_of_the_body(spark):
    body = "The decoder lowers\n  the logical error rate by 20 percent."
    df = spark.createDataFrame([(body, "decoder lowers the logical error rate"), (body, "raises"), (body, ""), (None, "x")], "b string, r string")
    assert [r.x for r in df.select(text.verbatim_span("b", "r").alias("x")).collect()] == ["decoder lowers\n  the logical error rate", None, None, None]


def test_scores_by_hand(spark):
    base = spark.createDataFrame([(1, 1, 1.0, 1.0, "sufficient_evidence", 1, 0), (2, 0, 0.0, 0.0, None, 0, 0), (3, 5, 2.0, -1.0, "budget_exhausted", 1, 3)], "claim_id long, nodes int, overlap double, consistency double, stopped_reason string, accepted int, rejected int")
    factors = scoring.confidence_factors(base)
    assert factors.orderBy("claim_id").first().nodes == 8.3333
    assert {r.claim_id: r.confidence for r in scoring.confidence(factors).collect()} == {1: 83, 2: 0, 3: 58}
    paper = spark.createDataFrame([(1, "parsed", False, "V", date(2024, 1, 1), True, 1), (2, None, True, None, None, False, 3)], "claim_id long, parse_status string, is_preprint boolean, venue string, published_at date, any_direct boolean, papers int")
    q = scoring.quality(scoring.quality_factors(paper, date(2024, 12, 31)))
    assert {r.claim_id: r.evidence_quality for r in q.collect()} == {1: 83, 2: 17}


def test_only_one_factor_changes(spark):
    rows = [(1, 1, 0.5, 0.5, "no_candidates", 1, 1), (2, 1, 0.9, 0.5, "no_candidates", 1, 1)]
    a, b = scoring.confidence_factors(spark.createDataFrame(rows, "claim_id long, nodes int, overlap double, consistency double, stopped_reason string, accepted int, rejected int")).orderBy("claim_id").collect()
    assert [k for k in scoring.CONFIDENCE_POINTS if a[k] != b[k]] == ["overlap"]


def test_the_two_scores_are_never_combined():
    """No arithmetic in the package has both scores as operands."""
    for path in (Path(__file__).parent.parent / "lodestone").rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
                names = {x.value for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str) and len(x.value) < 40}
                assert not ({"confidence"} & names and {"evidence_quality", "quality"} & names), path


def test_deep_trees_are_flattened(spark):
    chain = spark.createDataFrame([(1, k, k - 1 if k > 1 else None) for k in range(1, 7)], "paper_id long, node long, parent long")
    got = sorted((r.node, r.depth, r.parent) for r in trees.flatten(chain).collect())
    assert [d for _, d, _ in got] == [0, 1, 2, 3, 4, 4] and got[4][2] == got[5][2] == 4
    loop = chain.union(spark.createDataFrame([(1, 10, 11), (1, 11, 10)], chain.schema))
    assert sorted(r.node for r in trees.unreachable(loop).collect()) == [10, 11]


def test_walks_stop(spark):
    nodes = spark.createDataFrame([(1, 1, None, True, False), (1, 2, 1, False, False), (1, 3, 1, False, True), (2, 1, None, False, False)], "paper_id long, node long, parent long, expand boolean, sufficient boolean")
    got = trees.stop_reasons(trees.expanded(nodes, 5, walk="paper_id"), 5)
    assert {(r.paper_id, r.nodes_expanded, r.stopped_reason) for r in got.collect()} == {(1, 3, "sufficient_evidence"), (2, 1, "no_candidates")}
    few = trees.stop_reasons(trees.expanded(nodes, 1, walk="paper_id"), 1)
    assert {(r.paper_id, r.stopped_reason) for r in few.collect()} == {(1, "budget_exhausted"), (2, "budget_exhausted")}


def test_changes(spark):
    since = datetime(2024, 1, 10)
    ntz = lambda rows, schema: spark.createDataFrame(rows, schema)
    watched = spark.createDataFrame([(1,), (2,)], "claim_id long")
    evidence = ntz([(1, 1, "refutes", datetime(2024, 1, 11)), (2, 1, "refutes", datetime(2024, 1, 12)), (3, 2, "refutes", datetime(2024, 1, 10)), (4, 2, "refutes", datetime(2024, 1, 13)), (5, 3, "refutes", datetime(2024, 1, 13))], "evidence_id long, claim_id long, stance string, created_at timestamp_ntz")
    assert [(r.claim_id, r.evidence_id) for r in changes.stance_flips(evidence, watched, since).collect()] == [(1, 1)]
    score = ntz([(1, 1, 40, 55, datetime(2024, 1, 1)), (2, 1, 60, 70, datetime(2024, 1, 11)), (3, 2, 40, 40, datetime(2024, 1, 1)), (4, 2, 49, 31, datetime(2024, 1, 11)), (5, 3, 0, 0, datetime(2024, 1, 1)), (6, 3, 90, 90, datetime(2024, 1, 10))], "score_id long, claim_id long, confidence long, evidence_quality long, scored_at timestamp_ntz")
    assert [(r.claim_id, r.confidence_delta, r.quality_delta) for r in changes.score_movement(score, since).collect()] == [(1, 20, 15)]
    assert changes.new_evidence(evidence, watched, datetime(2025, 1, 1)).count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (3, "z")], "k long, v string")
    assert sorted((r.k, r.v) for r in history.upsert(old, new.where("k = 2"), ["k"]).collect()) == [(1, "a"), (2, "c")]
    assert [(r.k, r.v) for r in history.insert_ignore(old, new, ["k"], [F.asc_nulls_last("v")]).collect()] == [(3, "z")]
    assert {(r.k, r.action) for r in history.reconcile(old, new.where("v is not null"), ["k"], ["v"]).collect()} == {(1, "delete"), (2, "update"), (3, "insert")}


def test_evaluation_of_the_small_corpus(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "question long, path string")
    found = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (2, "x", 1), (2, "b", 9)], "question long, path string, rank int")
    cited = spark.createDataFrame([(1, "a"), (2, "x")], "question long, path string")
    r = evaluate.retrieval_metrics(gold, found, cited, k=5).first()
    assert (r.recall_at_k, r.citation_precision) == (0.5, 0.5)
    statements = spark.createDataFrame([(1, "Yes. [node 4]"), (1, "No source"), (2, "So. [Nodes 1, 7]")], "question long, s string").select("question", text.attributed_ids(F.col("s")).alias("ids"))
    valid = spark.createDataFrame([(1, [4]), (2, [7])], "question long, ids array<bigint>")
    assert abs(evaluate.unsupported_rate(statements, valid).first()[0] - 1 / 3) < 1e-12
    g = spark.createDataFrame([(1, "x", "p", "s"), (2, "y", "p", "s"), (3, "z", "p", "r")], "gold_id long, key string, path string, stance string")
    e = spark.createDataFrame([(1, "x", "p", "s"), (2, "y", "q", "r"), (3, "w", "p", "s")], "extracted_id long, key string, path string, stance string")
    m = evaluate.extraction_metrics(g, e, ["key"]).first()
    assert (round(m.precision, 6), round(m.recall, 6), round(m.f1, 6)) == (0.666667,) * 3 and m.stance_accuracy == 0.5


def test_shortlist_and_its_errors(spark):
    s = spark.createDataFrame([(0, "the surface code threshold is high"), (1, "a neural decoder, neural"), (2, "transversal CNOT gates")], "paper_id long, body string")
    assert [search.shortlist(s, q, 1).first().paper_id for q in ("surface code threshold", "neural decoder", "transversal CNOT")] == [0, 1, 2]
    for bad in (("", 1), ("x", 0)):
        with pytest.raises(ValueError):
            search.shortlist(s, *bad)


def test_shortlist_by_title_abstract_and_scope(spark):
    s = spark.createDataFrame([(1, "noise model"), (2, "noise model, noise model"), (6, "noise model"), (9, "noise model noise model noise model")], "paper_id long, body string")
    papers = [(1, "A noise model of noise", "the noise model"), (2, "Noise", None), (3, "Noise", "and a model"), (4, None, "noise model noise"), (5, "noise", "models"), (6, "Decoders", None)]
    p = spark.createDataFrame(papers, "paper_id long, title string, abstract string")
    scopes = spark.createDataFrame([(k, "one") for k in (1, 3, 4, 5, 9)] + [(2, "two"), (6, "two"), (1, "two"), (3, "one")], "paper_id long, scope_name string")
    ranks = lambda **x: [(r[0], round(r[1], 4)) for r in search.shortlist(s, "noise model", x.pop("limit", 9), **x).collect()]
    assert ranks() == [(9, 0.5), (2, 0.3), (1, 0.1), (6, 0.1)]
    assert ranks(papers=p) == [(2, 0.3), (1, 0.25), (4, 0.2), (5, 0.1), (6, 0.1), (3, 0.0333)]  # 3, 4 and 5 have no section, 9 is no paper
    assert ranks(papers=p, scope="one", paper_scopes=scopes) == [(1, 0.25), (4, 0.2), (5, 0.1), (3, 0.0333)]
    assert ranks(papers=p, scope="two", paper_scopes=scopes, limit=2) == [(2, 0.3), (1, 0.25)]
    assert ranks(scope="two", paper_scopes=scopes) == [(2, 0.3), (1, 0.1), (6, 0.1)]
    assert ranks(papers=p.drop("abstract")) == [(2, 0.3), (1, 0.15), (6, 0.1)]
    for bad in ({"scope": "one"}, {"scope": " ", "paper_scopes": scopes}, {"paper_scopes": scopes}):
        with pytest.raises(ValueError):
            search.shortlist(s, "noise", 1, papers=p, **bad)


def test_titles_are_normalised_over_all_lines(spark, tmp_path):
    from lodestone.plans import catalog

    docs = [(1, "One Title,\nwith \ufb01ve\nlines", "en", "s", 9), (2, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.key for r in catalog.QUERIES["normalize_title"](spark, str(tmp_path)).collect()} == {1: "onetitlewithfivelines", 2: None}


def test_tei_sections_and_broken_markup(spark):
    ns = 'xmlns="http://www.tei-c.org/ns/1.0"'
    body = f'<TEI {ns}><text><body><div><head>Methods</head><p coords="4,1,1;5,2,2">own</p><div><head>Noise model</head><p>inner</p></div><div><p>x</p></div></div></body></text></TEI>'
    rows = tei.tei_sections(body)
    assert [(r[1], r[2], r[5], r[6], r[7]) for r in rows] == [(None, "Methods", 4, 5, "own"), (1, "Methods/Noise model", None, None, "inner"), (1, "Methods/Untitled section 1", None, None, "x")]
    df = spark.createDataFrame([(1, body), (2, "<broken"), (3, None)], "paper_id long, tei_xml string")
    assert {r.paper_id for r in tei.parse_tei(df).collect()} == {1}


def test_feeds(spark):
    hn = spark.createDataFrame([(0, '{"id":1,"type":"story","title":"T","by":"a","time":1704067200,"score":5,"descendants":2}'), (1, '{"id":2,"type":"job"}'), (60, '{"id":3,"type":"story","time":1}')], "position int, value string")
    got = feeds.hacker_news(hn).collect()
    assert [(r.external_id, r.score, r.url) for r in got] == [("1", 5, "https://news.ycombinator.com/item?id=1")]
    assert feeds.since(feeds.hacker_news(hn), "2024-01-01 00:00:00").count() == 0
    dates = spark.createDataFrame([("Mon, 01 Jan 2024 10:00:00 GMT",), ("2024-01-01T10:00:00Z",), ("nonsense",)], "d string")
    assert [r.x for r in dates.select(feeds.parse_date(F.col("d")).alias("x")).collect()] == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10), None]
    work = '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/x","title":"T","abstract_inverted_index":{"codes":[1],"Quantum":[0],"errors.":[4],"reduce":[2],"physical":[3]},"authorships":[]}'
    w = papers.openalex(spark.createDataFrame([(work,)], "value string")).first()
    assert (w.openalex_id, w.doi, w.abstract) == ("W1", "10.1/x", "Quantum codes reduce physical errors.")


def test_polls_are_idempotent(spark):
    items = spark.createDataFrame([("a", 1, datetime(2024, 1, 2)), ("a", 1, datetime(2024, 1, 3)), ("b", 1, datetime(2024, 1, 1)), ("b", 2, datetime(2024, 1, 5))], "source string, id long, created_at timestamp")
    marks = spark.createDataFrame([("b", datetime(2024, 1, 1))], "source string, mark timestamp")
    first = poll.poll(items, items.limit(0), marks, ["source", "id"])
    assert sorted((r.source, r.id) for r in first.collect()) == [("a", 1), ("b", 2)]
    assert poll.poll(items, first, marks, ["source", "id"]).count() == 0
    assert {r.source: r.mark.day for r in poll.watermarks(items, marks).collect()} == {"a": 3, "b": 5}


def test_checks(spark):
    x = lambda c: one(spark, c)
    null = F.lit(None).cast("int")
    assert x(validation.citable(F.lit(1), F.lit(1))) and not x(validation.citable(F.lit(2), F.lit(1))) and not x(validation.citable(null, F.lit(1)))
    assert x(validation.one_target(null, F.lit(1))) and not x(validation.one_target(null, null))
    assert x(scoring.recency_ratio(F.lit(2.0))) == 1.0 and x(scoring.recency_ratio(F.lit(2.1))) == 0.67 and x(scoring.recency_ratio(F.lit(None).cast("double"))) == 0.0
