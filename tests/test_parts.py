"""Registries, polls that fail, reports, ids, records, parsers of catalogues and feeds."""

import json
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import registry
from lodestone.functions.text import Runs, normalize_title, split_quantity
from lodestone.operators import claims, history, records, scoring, trees, validation
from lodestone.plans import digest
from lodestone.sources import feeds, papers
from lodestone.streaming import poll


def test_registries_keep_names_apart():
    r = registry.Registry("thing")
    r.register("b", 1)
    r.register("a", 2)
    assert r.names() == ["b", "a"] and r.get("a") == 2
    for bad in ("b", " "):
        with pytest.raises(ValueError):
            r.register(bad, 3)
    with pytest.raises(KeyError, match="no thing c"):
        r.get("c")
    assert registry.EVIDENCE_SOURCES is not registry.DISCOURSE_SOURCES
    judges = registry.Registry("judge")
    judges.register("stance", lambda m: m[0]["content"].upper())
    assert registry.ask("stance", [{"content": "x"}], judges) == "X" and registry.ask("other", [], judges, default=lambda m: 7) == 7
    judges.register("broken", lambda m: 1 / 0)
    with pytest.raises(RuntimeError, match="broken"):
        registry.ask("broken", [], judges)


def test_a_failing_source_keeps_its_mark(spark):
    new, old = datetime(2024, 1, 3), datetime(2024, 1, 1)
    good = lambda: spark.createDataFrame([(1, old), (2, new)], "id long, posted_at timestamp_ntz")

    def bad():
        raise OSError("no answer")

    times = iter([datetime(2024, 2, k) for k in (1, 2, 3)])
    items, marks, failed = poll.poll_all({"a": good, "b": bad, "c": None, "d": good}, {"a": datetime(2024, 1, 2), "b": old}, clock=lambda: next(times))
    assert [r.id for r in items["a"].collect()] == [2] and items["d"].count() == 2 and set(items) == {"a", "d"}
    assert marks == {"a": datetime(2024, 2, 1), "b": old, "d": datetime(2024, 2, 3)} and failed == {"b": "no answer"}


def test_reports_are_dated_and_replaced(tmp_path):
    for value in (1, 2):
        path = digest.write_report(tmp_path / "out", date(2024, 5, 6), {"recall": value})
    assert path.name == "eval-2024-05-06.json" and json.loads(path.read_text()) == {"recall": 2} and len(list(path.parent.iterdir())) == 1


def test_ids_follow_the_greatest_without_gaps(spark):
    old = spark.createDataFrame([(7,), (3,)], "id long")
    got = history.insert_with_ids(old, spark.range(50).repartition(6).selectExpr("id as v"), "id")
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(8, 58)) and sorted(r.v for r in rows) == list(range(50)) and got.columns == ["id", "v"]
    assert history.insert_with_ids(old.limit(0), old.selectExpr("id as v"), "id").agg(F.max("id")).first()[0] == 2


def test_checks_are_marked_once(spark):
    df = spark.createDataFrame([(1, None), (2, datetime(2020, 1, 1)), (3, None)], "claim_id long, identity_checked_at timestamp_ntz")
    got = claims.mark_checked(df, spark.createDataFrame([(1,), (2,), (1,)], "claim_id long"), datetime(2024, 1, 1))
    assert {r.claim_id: r.identity_checked_at and r.identity_checked_at.year for r in got.collect()} == {1: 2024, 2: 2020, 3: None}


def test_one_bad_row_does_not_stop_the_others(spark):
    df = spark.createDataFrame([("3",), ("x",)], "v string")
    got = scoring.isolated(df, n=F.col("v").try_cast("int")).collect()
    assert [(r.n, r.error) for r in got] == [(3, None), (None, "n")]


def test_records_and_their_reasons(spark):
    own = {"extraction_model": "m", "prompt_version": "1"}
    claim = {"tree_node_id": "5", "claim_text": " A ", "normalized_text": "a", "claim_type": "t", "object_value": "12.5 ms", **own}
    cases = [
        (json.dumps({"records": [claim, 3]}), [(5, None, 12.5, "ms"), (None, "not a record", None, None)]),
        (json.dumps(json.dumps([{**claim, "unit": "s"}])), [(5, None, 12.5, "s")]),
        (json.dumps({**own, "method_text": "x"}), [(None, "tree_node_id", None, None)]),
        (json.dumps({**own, "tree_node_id": "q", "method_text": "x"}), [(None, "not a node id", None, None)]),
        (json.dumps({**own, "tree_node_id": 9, "method_text": "x"}), [(9, "outside the paper", None, None)]),
        (json.dumps({**own, "tree_node_id": 5, "text": "x"}), [(5, "record type", None, None)]),
        (json.dumps({"tree_node_id": 5, "dataset_name": "x", "prompt_version": "1"}), [(5, "extraction_model", None, None)]),
        (json.dumps({**own, "tree_node_id": 5, "metric_name": "x", "odd": 1}), [(5, "unknown odd", None, None)]),
        ("{", [(None, "malformed payload", None, None)]),
        ("3", [(None, "malformed payload", None, None)]),
        ("null", []),
        ("[]", []),
    ]
    raw = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "batch long, payload string")
    nodes = spark.createDataFrame([(k, 5) for k in range(len(cases))], "batch long, tree_node_id long")
    got = records.within_paper(records.read_records(raw, "batch", "payload"), nodes, "batch").orderBy("batch", "at").collect()
    for k, (_, want) in enumerate(cases):
        assert [(r.tree_node_id, r.reason, r.object_value, r.unit) for r in got if r.batch == k] == want, cases[k]
    assert records.stamp(raw, run=4).first().run == 4
    assert split_quantity("-.5e1 %") == (-5.0, "%") and split_quantity("about 3") == (None, None)


def test_longest_runs_match_a_table():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, 15) if i + n <= len(a) and a[i : i + n] == b[j : j + n]), default=0)
        assert Runs(a).longest(b) == best


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
  title</title><summary> An abstract </summary><published>2024-01-05T10:00:00Z</published><author><name>Ann Lee</name></author><author><name>Bo Ray</name></author><link href="http://arxiv.org/abs/1" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/1"/><arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1/q</arxiv:doi><category term="quant-ph"/></entry></feed>"""
RSS = """<rss><channel><item><guid>g1</guid><link>http://x/1</link><title> One </title><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item><item><link>http://x/2</link><title>Two</title><pubDate>2024-01-06T10:00:00+02:00</pubDate></item></channel></rss>"""


def test_catalogues(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    a = papers.arxiv_atom(spark, str(tmp_path / "a.xml")).first()
    assert (a.arxiv_id, a.title, a.abstract, a.published_at, a.authors) == ("2401.00001v2", "A title", "An abstract", date(2024, 1, 5), ["Ann Lee", "Bo Ray"])
    assert (a.doi, a.pdf_url, a.categories) == ("10.1/q", "http://arxiv.org/pdf/1", ["quant-ph"])
    s2 = {"paperId": "p1", "title": "T", "abstract": None, "venue": "V", "publicationDate": "2024-02-03", "externalIds": {"DOI": "10.1/a", "ArXiv": None}, "authors": [{"name": "Ann"}]}
    cr = {"message": {"items": [{"DOI": "10.1/z"}, {"DOI": "10.1/y"}]}}
    oa = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/q", "title": "T", "publication_date": "2024-01-01", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "Ann"}}]}
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    r = papers.semantic_scholar(one(s2)).first()
    assert (r.s2_id, r.doi, r.arxiv_id, r.published_at, r.authors) == ("p1", "10.1/a", None, date(2024, 2, 3), ["Ann"])
    assert papers.crossref_doi(one(cr)).first().doi == "10.1/z" and papers.crossref_doi(one({"message": {"items": []}})).first().doi is None
    r = papers.openalex(one(oa)).first()
    assert (r.openalex_id, r.doi, r.abstract, r.authors) == ("W1", "10.1/q", "a b a", ["Ann"])


def test_feeds_of_communities(spark, tmp_path):
    (tmp_path / "r.xml").write_text(RSS)
    r = feeds.rss(spark, str(tmp_path / "r.xml")).orderBy("external_id").select("external_id", "title", F.date_format("posted_at", "yyyy-MM-dd HH:mm").alias("at")).collect()
    assert [tuple(x) for x in r] == [("g1", "One", "2024-01-05 10:00"), ("http://x/2", "Two", "2024-01-06 08:00")]
    (tmp_path / "a.xml").write_text(ATOM)
    a = feeds.atom(spark, str(tmp_path / "a.xml")).first()
    assert (a.source, a.external_id, a.url, a.author, a.posted_at.day) == ("rss", "http://arxiv.org/abs/2401.00001v2", "http://arxiv.org/abs/1", "Ann Lee", 5)
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    child = {"data": {"id": "i", "permalink": "/r/x", "title": "T", "author": "a", "selftext": "s", "created_utc": 1704448800.0, "score": 3, "num_comments": 2}}
    r = feeds.reddit(one({"data": {"children": [child]}})).first()
    assert (r.source, r.external_id, r.url, r.score, r.num_comments, r.posted_at.year) == ("reddit", "i", "https://www.reddit.com/r/x", 3, 2, 2024)
    daily = [{"publishedAt": None, "title": None, "numComments": 1, "paper": {"id": "2401.1", "title": "P", "summary": "s", "upvotes": 9, "publishedAt": "2024-01-02T00:00:00.000Z", "submittedOnDailyAt": None}}]
    r = feeds.daily_papers(one(daily)).first()
    assert (r.external_id, r.title, r.score, r.posted_at.day) == ("2401.1", "P", 9, 2)


def test_currency_of_trees_by_counts_and_versions(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, 1)], "paper_id long, version long")
    wanted = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 1)], "paper_id long, wanted long")
    assert {r.paper_id: r.current for r in trees.currency(nodes, wanted).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.paper_id: r.current for r in trees.currency(nodes, 1).collect()} == {1: False, 2: False, 3: True}


def test_rationales_stand_in_their_node_but_for_white_space(spark):
    nodes = spark.createDataFrame([(1, "One  two\nthree."), (2, None)], "tree_node_id long, body string")
    links = spark.createDataFrame([(1, 1, "two three"), (2, 1, "two, three"), (3, 9, "two"), (4, 1, None), (5, 1, " "), (6, 2, "two")], "evidence_id long, tree_node_id long, rationale string")
    got = {r.evidence_id: r.verdict for r in validation.link_verdicts(links, nodes).collect()}
    none = "no verbatim rationale"
    assert got == {1: "ok", 2: none, 3: "unknown node", 4: none, 5: none, 6: "unknown node"}


def test_groups_with_a_changed_member_are_taken_apart(spark):
    claim = spark.createDataFrame([(1, 7, None), (2, 8, 1), (3, 8, 1), (4, 7, None)], "claim_id long, paper_id long, canonical_claim_id long")
    changed = spark.createDataFrame([(3,), (3,), (None,)], "claim_id long")
    assert sorted(map(tuple, claims.take_apart(claim, changed).collect())) == [(1, 7, 1), (1, 8, 2)]


def test_too_many_lines_in_one_order_fail(spark, monkeypatch, tmp_path):
    from lodestone.plans import roles

    monkeypatch.setattr(roles, "LINES", 3)
    columns = [F.lit(1).cast("string" if c in ("l_returnflag", "l_linestatus") else "long").alias(c) for c in [*roles.LINE_COLUMNS, "l_orderkey"]]
    spark.range(3).select(*columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="too many lines"):
        roles.Roles(spark, str(tmp_path)).evidence.collect()


def test_evidence_is_counted_in_bounded_tasks(spark, monkeypatch):
    """F8: tasks grew with the table. Repeated claims count their evidence as often as they are there."""
    monkeypatch.setattr(claims, "TASK_ROWS", 2)
    claim = spark.createDataFrame([(1, None), (2, 1), (2, 1), (3, None), (None, 1), (None, None), (5, None)], "claim_id long, canonical_claim_id long")
    rows = [(1, 10, "supports"), (1, 10, "refutes"), (1, 11, None), (3, None, "supports"), (2, 7, "supports")]
    got = claims.root_evidence(claim, spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "evidence_id long, claim_id long, paper_id long, stance string"))
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, 3, 2, 1), (2, 1, 6, 2, 2), (3, 3, 1, 0, 1), (None, 1, 3, 2, 1)], key=repr)


def test_claims_that_hang_on_none_are_not_looked_up(spark):
    """all of them met in the task of the null key."""
    claim = spark.createDataFrame([(20, None, "a"), (10, None, "b"), (11, 10, "c"), (30, 9, "d"), (7, 8, "e")], "claim_id long, canonical_claim_id long, more string")
    groups = spark.createDataFrame([(0, 10), (20, 20), (20, 30)], "canonical_id long, claim_id long")
    got = claims.repoint(claim, groups)
    assert got.columns == claim.columns and sorted(map(tuple, got.collect())) == [(7, 8, "e"), (10, 0, "b"), (11, 0, "c"), (20, None, "a"), (30, 20, "d")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "isnotnull(canonical_claim_id" in plan and "isnull(canonical_claim_id" in plan


def test_long_titles_cross_in_small_batches(spark):
    """ten thousand whole texts were in a worker at a time. ASCII texts don't reach one at all."""
    texts = ["", "A-b 1_2\n", "Straße ÄÖ ﬁn ⅷ ½ İI", "٣ x²́é", "日本 Title!", None, "\x00\x7fZ", "ǅ K"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", normalize_title("t").alias("key"))
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()) for t in texts]
    assert [r.key for r in got.orderBy("k").collect()] == want
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
