"""Relational operators on small hand-made rows: order, ties, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from sievelark.operators import components, feedback, memory, rank, recall, report, resolve

ITEM = "item_ord bigint, title string, abstract string, url string, source string, arxiv_id string, semantic_paper_id string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def as_of(s="2026-02-21 00:00:00"):
    return F.lit(s).cast("timestamp")


def test_recall(spark):
    df = items(spark, [(1, "Agents", "Alignment of agents", "u", "arxiv", "1", None), (2, None, None, "v", "arxiv", "2", None), (3, "agents spam", "", "w", "arxiv", "", None)])
    got = recall.keyword_recall(df, ["alignment", "AGENT", "alignment"], ["Spam"]).select("item_ord", "matched_keywords").collect()
    assert [(r.item_ord, r.matched_keywords) for r in got] == [(1, ["alignment", "AGENT", "alignment"])]
    assert recall.keyword_recall(df, []).count() == 3 and recall.keyword_recall(df, [], ["agents"]).count() == 1
    assert recall.keyword_recall(df.limit(0), ["a"]).count() == 0


def test_first_wins_and_gate(spark):
    df = items(spark, [(3, "c", "", "u", "arxiv", "1", None), (1, "a", "", "u", "manual", "1", None), (2, "b", "", "u", "arxiv", "", None), (4, "d", "", "u", "arxiv", None, None)])
    assert sorted(r.item_ord for r in recall.first_wins(df, recall.identity(), F.col("item_ord")).collect()) == [1, 2]
    assert recall.gated(df, 4, 1, [F.col("item_ord")]).count() == 4 and recall.gated(df, 3, 1, [F.col("item_ord")]).count() == 1
    assert [(r.item_ord, r.n) for r in recall.numbered(df, [F.col("item_ord")]).orderBy("n").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_memory_keys(spark):
    df = items(spark, [(1, "", "", "u", "arxiv", "arXiv:2501.00001", "12345"), (2, "", "", "https://hub.example/papers/abc/", "huggingface", None, ""), (3, "", "", "", "manual", None, None)])
    got = {r.item_ord: r.k for r in df.select("item_ord", memory.item_keys(df).alias("k")).collect()}
    assert got == {1: ["arxiv:2501.00001", "semantic:CorpusId:12345", "CorpusId:12345"], 2: ["hf:https://hub.example/papers/abc"], 3: []}


def test_memory_life(spark):
    m = spark.createDataFrame([("arxiv:1", "2026-01-22 00:00:00"), ("old", "2026-01-10 00:00:00"), (" ", "2026-02-20 00:00:00"), ("nul", None)], "seen string, t string").select("seen", F.col("t").cast("timestamp").alias("seen_at"))
    live = memory.live(m, as_of(), 30)
    assert [r.seen for r in live.collect()] == ["arxiv:1"]
    df = items(spark, [(1, "", "", "u", "semantic_scholar", "1", "s2-a"), (2, "", "", "u", "semantic_scholar", None, "s2-b"), (3, "", "", "", "manual", None, None)])
    assert sorted(r.item_ord for r in memory.suppress(df, live).collect()) == [2, 3]
    assert tuple(memory.suppression_stats(df, live).first()) == (3, 1, 2)
    up = memory.upsert(m, spark.createDataFrame([("old",), ("new",)], "seen string"), as_of())
    assert {r.seen: str(r.seen_at) for r in up.where("seen in ('old', 'new')").collect()} == {"old": "2026-02-21 00:00:00", "new": "2026-02-21 00:00:00"}
    assert [r.seen for r in memory.capped(m.where("seen <> ' '"), 2).collect()] == ["arxiv:1", "old"]
    bad = spark.createDataFrame([("{invalid-json",), ('{"seen": {"a": "2026-01-01T00:00:00Z", "b": "x", "": "2026-01-01"}}',), (None,)], "value string")
    assert [r.seen for r in memory.load_json(bad).collect()] == ["a"]


def test_update_from_report_marks_only_what_is_shown(spark):
    m = spark.createDataFrame([], "seen string, seen_at timestamp")
    df = items(spark, [(1, "", "", "https://a.example/x/", "arxiv", "1", None), (2, "", "", "https://a.example/y", "huggingface", None, None), (3, "", "", "https://a.example/x", "manual", "9", None)])
    links = report.shown_links(spark.createDataFrame([("r", "<a href='HTTPS://A.example/x?utm=1'>x</a>")], "run_id string, report_html string"))
    assert [r.seen for r in memory.update_from_report(m, df, links, ["arxiv", "huggingface"], as_of(), 30).collect()] == ["arxiv:1"]


EVENT = "event_id string, run_id string, item_id string, label string, received_at timestamp, resolved_semantic_paper_id string"


def test_feedback_three_events(spark):
    t = "2026-02-21 10:0{}:00"
    ev = spark.createDataFrame([("evt_1", "run-1", "p01", "positive", t.format(0), None), ("evt_2", "run-1", "p01", " Negative ", t.format(1), None), ("evt_3", "run-1", "p02", "positive", t.format(2), None), ("evt_4", "run-1", "p09", "positive", t.format(3), ""), ("evt_5", "run-1", "p01", "spam", t.format(4), None)], EVENT.replace("timestamp", "string")).withColumn("received_at", F.col("received_at").cast("timestamp"))
    man = spark.createDataFrame([("run-1", "p01", "100", 1), ("run-1", "p02", "200", 2), ("run-1", "p02", "CorpusId:200", 3)], "run_id string, item_id string, semantic_paper_id string, pos int")
    seeds = spark.createDataFrame([("CorpusId:7", "negative")], "paper_id string, polarity string")
    order = [F.col("received_at"), F.col("event_id")]
    for own in ("resolved_semantic_paper_id", None):
        after, judged = feedback.apply_feedback(ev, feedback.manifest_index(man, F.col("pos")), seeds, order, own)
        assert {tuple(r) for r in after.collect()} == {("CorpusId:7", "negative"), ("CorpusId:100", "negative"), ("CorpusId:200", "positive")}
        assert {r.event_id: r.reason for r in judged.collect()} == {"evt_1": feedback.SUPERSEDED, "evt_2": None, "evt_3": None, "evt_4": feedback.NO_MAPPING if own else feedback.UNKNOWN_ITEM, "evt_5": feedback.INVALID}
        assert tuple(feedback.counters(judged).first()) == (2, 3, 1, 1)


def test_made_late_wins_over_received_late(spark):
    """The last by created_at and event_id wins, whenever it came; runs do not mix, judged events stay out, an item without an id is told apart."""
    rows = [
        ("a", "r1", "p01", "positive", "2026-02-21T10:05:00Z", 1, "pending"), ("b", "r1", "p01", "negative", "2026-02-21T11:00:00+02:00", 9, "Pending "), ("c", "r2", "p01", "negative", "2026-02-21T10:09:00Z", 2, "pending"),
        ("d", "r1", "p01", "negative", "2026-02-21T12:00:00Z", 3, "applied"), ("e", "r1", "p03", "positive", "2026-02-21T10:00:00Z", 4, "pending"), ("f", "r1", "p02", "positive", "2026-02-21T10:00:00Z", 5, "pending"), ("g", "r1", "p02", "undecided", "2026-02-21T10:00:00Z", 5, "pending"),
    ]
    ev = feedback.pending(spark.createDataFrame(rows, "event_id string, run_id string, item_id string, label string, created_at string, received_at int, status string"))
    man = spark.createDataFrame([("r1", "p01", "1", 1), ("r2", "p01", "2", 1), ("r1", "p02", "3", 2), ("r1", "p03", "", 3)], "run_id string, item_id string, semantic_paper_id string, pos int")
    order = feedback.event_order(ev, F.lit("2026-03-01 00:00:00"))
    after, judged = feedback.apply_feedback(ev, feedback.manifest_index(man, F.col("pos")), spark.createDataFrame([("CorpusId:3", "positive")], "paper_id string, polarity string"), order, None)
    assert {tuple(r) for r in after.collect()} == {("CorpusId:1", "positive"), ("CorpusId:2", "negative")}
    assert {r.event_id: r.reason for r in judged.collect()} == {"a": None, "b": feedback.SUPERSEDED, "c": None, "e": feedback.NO_ID, "f": feedback.SUPERSEDED, "g": None}
    late = spark.createDataFrame([("x", "2026-02-01T00:00:00Z"), ("y", "next week")], "event_id string, created_at string")
    assert late.orderBy(*feedback.event_order(late, F.lit("2026-03-01 00:00:00"))).collect()[-1].event_id == "y"


def test_undecided_clears_and_ties(spark):
    seeds = spark.createDataFrame([("a", "positive"), ("b", "negative")], "paper_id string, polarity string")
    decided = spark.createDataFrame([("a", "undecided"), ("b", "positive"), ("c", "negative")], "paper_id string, label string")
    assert {tuple(r) for r in feedback.merge_seeds(seeds, decided).collect()} == {("b", "positive"), ("c", "negative")}
    ties = spark.createDataFrame([("k", "positive", 5, 1), ("k", "negative", 5, 2)], "k string, label string, t int, pos int")
    assert feedback.latest_labels(ties, ["k"], [F.col("t"), F.col("pos")]).first().label == "negative"
    ids = spark.createDataFrame([("CorpusId:20",), ("CorpusId:3",), ("B",), ("a",)], "paper_id string")
    assert [r.paper_id for r in ids.orderBy(*feedback.seed_order()).collect()] == ["CorpusId:3", "CorpusId:20", "a", "B"]


def test_scores(spark):
    answers = spark.createDataFrame([(0, '```json\n[{"paper_num": 1, "score": "7", "reason": "x"}, {"paper_num": 1, "score": 9}, {"score": 3}, 5, {"paper_num": 2, "score": "bad"}]\n```'), (1, '[{"paper_num": 1, "score": 4}, {"paper_num": "two", "score": 8}, {"paper_num": 2, "score": 8}]'), (2, "no list"), (3, None)], "batch_id bigint, answer string")
    got = rank.parse_scores(answers)
    assert sorted((r.batch_id, r.paper_num, r.score, r.bad) for r in got.collect()) == [(0, 1, 0.7, False), (0, 1, 0.9, False), (0, 2, 0.0, False), (1, 1, 0.4, True)]
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "d")], "batch_id bigint, pos bigint, item_ord string")
    assert sorted((r.item_ord, r.relevance_score) for r in rank.join_scores(rows, got).collect()) == [("a", 0.9), ("a", 0.9), ("b", 0.0), ("d", 0.4)]
    rows = rows.unionByName(spark.createDataFrame([(1, 2, "e"), (2, 1, "f"), (3, 1, "g"), (4, 1, "h")], rows.schema))
    got = rank.with_fallback(rows, got, answers)
    assert sorted((r.item_ord, r.relevance_score, r.filter_reason) for r in got.collect()) == [("a", 0.9, ""), ("a", 0.9, ""), ("b", 0.0, ""), ("d", 0.4, ""), ("e", 0.0, ""), ("f", 0.0, ""), ("g", 0.0, "")]
    before = rows.withColumns({"relevance_score": F.lit(0.3), "filter_reason": F.lit("coarse")})
    assert {(r.item_ord, r.relevance_score, r.filter_reason) for r in rank.with_fallback(before, rank.parse_scores(answers), answers).where("batch_id > 0").collect()} == {("d", 0.4, ""), ("e", 0.3, "coarse"), ("f", 0.3, "coarse"), ("g", 0.3, "coarse")}


def test_title_matches(spark):
    kind = "id bigint, title string, year int, authors array<string>"
    a = spark.createDataFrame([(1, "Same, Title!", 2020, ["Ann"]), (2, "Same title", 2010, ["Bob"]), (3, "", 2020, [])], kind)
    b = spark.createDataFrame([(10, "same title", 2021, ["Cid"]), (11, "same  title", None, ["BOB"]), (12, "other title", 2020, ["Ann"]), (13, None, 2020, None)], kind)
    assert sorted((r.id, r.match_id) for r in resolve.title_matches(a, b).collect()) == [(1, 10), (2, 11)]
    assert [tuple(r) for r in resolve.title_matches(a, a.unionByName(a.withColumn("id", F.col("id") + 100))).orderBy("id").collect()] == [(1, 101), (2, 102)]


def test_budget(spark):
    df = items(spark, [(1, "t1", "", "u1", "arxiv", "1", None), (2, "t2", "", "u2", "arxiv", "2", None), (3, "t3", "", "u3", "arxiv", None, "77")])
    by_arxiv = spark.createDataFrame([("1", "CorpusId:1", False), ("2", None, True)], "arxiv_key string, found_id string, failed boolean")
    by_title = spark.createDataFrame([], "item_ord bigint, found_id string")
    got = {r.item_ord: (r.paper_id, r.status, r.method) for r in resolve.resolve(df, by_arxiv, by_title).collect()}
    assert got == {1: ("CorpusId:1", "resolved", "arxiv"), 2: (None, "error", "arxiv"), 3: ("CorpusId:77", "existing", "existing")}
    over = resolve.resolve(df, by_arxiv, by_title, 0)
    assert {r.item_ord: (r.status, r.method, r.error) for r in over.collect()} == {1: ("error", "none", "budget_exhausted"), 2: ("error", "none", "budget_exhausted"), 3: ("existing", "existing", None)}
    assert resolve.stats(over).first().asDict() == {"resolved": 1, "unresolved": 2, "errors": 0, "cache_hits": 0, "lookups": 0, "budget_skips": 2}
    more = df.unionByName(items(spark, [(4, "t1", "", "u1", "Arxiv", "1", None), (5, "t5", "", "u5", "manual", "1", None)]))
    got = resolve.resolve(more, by_arxiv, by_title, 1)
    assert {r.item_ord: (r.status, r.method) for r in got.collect()} == {1: ("resolved", "arxiv"), 2: ("error", "none"), 3: ("existing", "existing"), 4: ("resolved", "arxiv"), 5: ("unresolved", "none")}
    assert resolve.stats(got).first().asDict() == {"resolved": 3, "unresolved": 2, "errors": 0, "cache_hits": 1, "lookups": 1, "budget_skips": 1}
    many = items(spark, [(i, f"t{i}", "", f"u{i}", "arxiv", str(i), None) for i in range(30)])
    assert resolve.resolve(many, by_arxiv, by_title, 25, has_key=False).where("error is null").count() == resolve.KEYLESS


def test_manifest_and_decoration(spark):
    runs = spark.createDataFrame([("r1", "<ul><li><a href='https://a.example/2/'>two</a></li><li><A HREF=\"https://a.example/1?x=1\">one</A> and <a href='https://a.example/2'>again</a></ul>"), ("r2", None)], "run_id string, report_html string")
    df = items(spark, [(1, " One ", "", "https://a.example/1", "arxiv", "", "123456"), (2, "Two", "", "https://a.example/2", "arxiv", None, None), (3, "Hidden", "", "https://a.example/3", "arxiv", None, "5")])
    m = report.manifest(runs, df)
    assert sorted((r.item_id, r.item_ord, r.title, r.semantic_paper_id) for r in m.collect()) == [("p01", 2, "Two", None), ("p02", 1, "One", "CorpusId:123456")]
    assert [tuple(r) for r in report.questionnaire(m).collect()] == [("r1", "p02", "undecided", "")]
    notes = spark.createDataFrame([("https://a.example/2", "*")], "href string, note string")
    html = {r.run_id: r.report_html for r in report.decorated(runs, notes).collect()}["r1"]
    assert html.count("*") == 2 and "two</a>*" in html and "one</a> and" in html
    assert report.visible(df, report.shown_links(runs.where("run_id = 'r2'")), all_if_none=True).count() == 3
    assert report.visible(df, report.shown_links(runs.where("run_id = 'r2'"))).count() == 0
    page = report.wrap_html("x", "t", "m")
    assert "<style/></head>" in report.with_head(page, "<style/>") and report.with_head("y", "z") == "zy"


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)] + [(500, 500 + i) for i in range(60)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and got[200] == 200 and all(got[500 + i] == 500 for i in range(60))
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
    text = {r.node: r.root for r in components.connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"), "a", "b").collect()}
    assert text == {"a": "a", "b": "a", "c": "a"}


@pytest.mark.parametrize("papers,blogs,want", [(2, 1, "2 papers + 1 blogs reviewed"), (0, 3, "3 blogs reviewed"), (4, 0, "4 papers reviewed")])
def test_header(spark, papers, blogs, want):
    assert spark.range(1).select(report.header(F.lit(papers), F.lit(blogs)).alias("h")).first().h == want


def test_footer(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a"],)], "matched_keywords array<string>")
    assert report.keyword_footer(df).first().footer == "a, b" and report.keyword_footer(df.limit(0)).first().footer == "AI Research"
