"""Feed documents, state files and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from sievelark.sources import feeds, state

ATOM = """<feed><entry><id>http://arxiv.example/abs/2501.00001v1</id><title>A
 title </title><summary> Sum
mary</summary><published>2025-01-01T00:00:00Z</published><updated>2025-01-02T00:00:00Z</updated><author><name>Ann</name></author><author><name>Bo</name></author><category term="cs.X"/><category term="cs.Y"/><link href="http://arxiv.example/pdf/1" title="pdf"/><link href="h" rel="alternate"/></entry></feed>"""
RSS = "<rss><channel><title>f</title>" + "".join(f"<item><title>t{i}</title><link>https://b.example/{i}</link><pubDate>Mon, 06 Jan 2025 00:00:00 GMT</pubDate><description>&lt;p&gt;body {i}&lt;/p&gt;</description></item>" for i in range(7)) + "</channel></rss>"


def docs(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_atom(spark):
    r = feeds.atom_items(docs(spark, ATOM, "<broken", None)).collect()
    assert len(r) == 1 and (r[0].title, r[0].abstract, r[0].arxiv_id, r[0].categories, r[0].pdf_url) == ("A  title", "Sum mary", "2501.00001v1", ["cs.X", "cs.Y"], "http://arxiv.example/pdf/1")
    assert [a.name for a in r[0].authors] == ["Ann", "Bo"]


def test_rss(spark):
    df = spark.createDataFrame([("f", RSS), ("g", "")], "feed_key string, value string")
    r = feeds.rss_posts(df).orderBy("pos").collect()
    assert [x.title for x in r] == ["t0", "t1", "t2", "t3", "t4"] and r[0].content == "body 0"
    both = "<rss><channel><title>f</title><item><title>a</title><description>short</description><content:encoded>long</content:encoded></item><item><title>b</title><content:encoded>" + "x" * 2500 + "</content:encoded></item></channel></rss>"
    a, b = feeds.rss_posts(spark.createDataFrame([("f", both)], "feed_key string, value string"), shortened=5000).orderBy("pos").collect()
    assert a.content == "short" and b.content == "x" * 2000 + feeds.FULL_NOTE


def test_daily_and_recommended(spark):
    d = json.dumps([{"paper": {"id": "2501.1", "title": "T", "summary": "S", "authors": [{"name": "Ann"}]}, "publishedAt": "2025-01-01T00:00:00Z"}])
    r = feeds.daily_items(docs(spark, d, "{}")).collect()
    assert len(r) == 1 and (r[0].arxiv_id, r[0].url, r[0].published_date) == ("2501.1", "https://arxiv.example/abs/2501.1", "2025-01-01T00:00:00Z")
    s = json.dumps({"recommendedPapers": [{"paperId": "12", "title": "T", "year": 2020, "externalIds": {"ArXiv": "2001.1"}, "authors": [{"name": f"N{i}" if i % 2 else ""} for i in range(30)]}, {"paperId": "x", "title": "", "year": 0}]})
    r = feeds.recommended_items(docs(spark, s, "nonsense")).collect()
    assert len(r) == 1 and (r[0].semantic_paper_id, r[0].published_date, r[0].url, len(r[0].authors)) == ("CorpusId:12", "2020-01-01", "https://arxiv.example/abs/2001.1", 10)


def test_manual_pages_seeds(spark):
    r = feeds.manual_items(docs(spark, json.dumps({"papers": [{"title": "T", "abstract": "A", "url": "u"}, "https://arxiv.org/abs/2501.00001", {"title": "no url"}]}), "[]", None)).orderBy("item_ord").collect()
    assert [(x.title, x.arxiv_id, x.source) for x in r] == [("T", None, "manual"), ("[Metadata not fetched]", "2501.00001", "manual")]
    p = feeds.page_items(spark.createDataFrame([("u", "Head\nBody text")], "url string, value string")).first()
    assert (p.title, p.abstract) == ("Head", "Body text")
    s = feeds.seed_ids(docs(spark, '{"positive_paper_ids": ["1", " x:2 ", ""], "negative_paper_ids": ["abc"]}', "bad"))
    assert {tuple(x) for x in s.collect()} == {("CorpusId:1", "positive"), ("x:2", "positive"), ("abc", "negative")}
    assert feeds.rejects(docs(spark, "{", '{"run_id": "a"}'), "value", "run_id string").count() <= 1


def test_state(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"x": 1}')
    bad.write_text("[1]")
    assert state.load_object(spark, str(good)) == {"x": 1} and state.load_object(spark, str(bad), {}) == {} and state.load_object(spark, str(tmp_path / "none"), {"d": 1}) == {"d": 1}
    with pytest.raises(ValueError):
        state.load_object(spark, str(bad))
    with pytest.raises(FileNotFoundError):
        state.load_object(spark, str(tmp_path / "none"))


def test_versions_and_queue(spark, tmp_path):
    v = state.Versioned(spark, str(tmp_path / "t"))
    assert v.read() is None and v.write(spark.range(2), dry_run=True) is None and v.read() is None
    v.write(spark.range(2))
    v.write(v.read().unionByName(spark.range(5, 6)))
    assert v.read().count() == 3
    key = state.queue_event(spark, str(tmp_path / "q"), "r", "p01", " Positive ", "x", "2026-01-01T00:00:00Z")
    assert spark.read.json(str(tmp_path / "q")).first().event_id == key
    with pytest.raises(ValueError):
        state.queue_event(spark, str(tmp_path / "q"), "r", "p01", "maybe", "x", "")


def test_manifests_upsert_status(spark, tmp_path):
    for name, paper in (("m_1", "1"), ("m_2", "2")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"run_id": "r", "papers": [{"item_id": "p01", "semantic_paper_id": paper}]}))
    (tmp_path / "m_3.json").write_text("{broken")
    from sievelark.operators.feedback import manifest_index

    entries = state.manifest_entries(state.documents(spark, f"{tmp_path}/m_*.json"))
    assert manifest_index(entries, [F.col("file_rank"), F.col("pos")]).first().semantic_paper_id == "CorpusId:2"
    a, b = spark.createDataFrame([(1, "old"), (2, "two")], "k int, v string"), spark.createDataFrame([(1, "new")], "k int, v string")
    assert {tuple(r) for r in state.upsert(a, b, ["k"]).collect()} == {(1, "new"), (2, "two")}
    ev = spark.createDataFrame([("e1", "pending", None, None, None), ("e2", "pending", None, None, None)], "event_id string, status string, resolved_semantic_paper_id string, applied_at string, error string")
    judged = spark.createDataFrame([("e1", "applied", "CorpusId:1", None)], "event_id string, outcome string, paper_id string, reason string")
    got = {r.event_id: (r.status, r.resolved_semantic_paper_id, r.applied_at) for r in state.update_status(ev, judged, F.lit("2026-01-01T00:00:00Z")).collect()}
    assert got == {"e1": ("applied", "CorpusId:1", "2026-01-01T00:00:00Z"), "e2": ("pending", None, None)}


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.path[-5:], r.is_pdf, r.encoded is not None) for r in state.pdf_pages(files).collect()) == [("a.pdf", True, True), ("b.pdf", False, False)]
    assert {r.filename for r in state.attachments(files).collect()} == {"a.pdf", "b.pdf"}
