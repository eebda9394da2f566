"""The digest, applying feedback from files, settings, the command line, the data source and the keyed stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sievelark import config
from sievelark.plans import pipeline
from sievelark.sources.plugin import PagedItems
from sievelark.sources.state import Versioned
from sievelark.streaming import events as S

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_digest(spark):
    s = config.load({"include": ["retrieval", "planning", "alignment"], "exclude": ["jailbreaks"], "coarse_threshold": 5, "coarse_keep": 8, "keep": 3, "memory_ttl_days": 120}, {})
    out = pipeline.run_digest(spark, DATA, s, F.lit("2025-06-30 00:00:00").cast("timestamp_ntz"))
    n = {k: v.count() for k, v in out.items()}
    assert n["fetched"] >= n["new"] >= n["unique"] >= n["recalled"] >= n["coarse"] >= n["fine"] == n["lines"] == 3
    lines = [r.line for r in out["lines"].orderBy("n").collect()]
    assert lines[0].startswith("1. ") and "Community Signals" in lines[0]


def test_apply_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/run_1.json").write_text(json.dumps({"run_id": "r", "papers": [{"item_id": "p01", "semantic_paper_id": "1"}, {"item_id": "p02", "semantic_paper_id": "2"}]}))
    rows = [("e1", "r", "p01", "positive", "pending", 1), ("e2", "r", "p01", "negative", "pending", 2), ("e3", "r", "p02", "positive", "pending", 3), ("e4", "r", "p02", "negative", "applied", 4), ("e5", "r", "p09", "positive", "pending", 5)]
    df = spark.createDataFrame(rows, "event_id string, run_id string, item_id string, label string, status string, t int")
    df.select("*", F.timestamp_seconds("t").alias("received_at"), F.lit(None).cast("string").alias("resolved_semantic_paper_id")).write.parquet(str(tmp_path / "ev"))
    args = (spark, str(tmp_path / "ev"), str(tmp_path / "m/*.json"), str(tmp_path / "seeds"))
    want = {"applied": 2, "rejected": 2, "invalid": 0, "skipped": 1, "positive": 1, "negative": 1}
    assert pipeline.apply_files(*args, dry_run=True) == want and Versioned(spark, str(tmp_path / "seeds")).read() is None
    assert pipeline.apply_files(*args) == want
    assert {tuple(r) for r in Versioned(spark, str(tmp_path / "seeds")).read().collect()} == {("CorpusId:1", "negative"), ("CorpusId:2", "positive")}
    with pytest.raises(Exception):
        pipeline.apply_files(spark, str(tmp_path / "none"), *args[2:])
    assert Versioned(spark, str(tmp_path / "seeds")).read().count() == 2


def test_settings():
    s = config.load({"keep": 7, "unknown": 1, "include": ["a"]}, {"SIEVELARK_KEEP": "x", "SIEVELARK_WITH_BLOGS": "Off", "SIEVELARK_EXCLUDE": "b, c,", "SIEVELARK_WITH_PAPERS": "banana", "SIEVELARK_SECRET": "s"})
    assert (s.keep, s.include, s.exclude, s.with_blogs, s.with_papers, s.secret) == (7, ("a",), ("b", "c"), False, True, "s") and "s'" not in repr(s)


def test_command_line(spark, capsys):
    from sievelark.__main__ import main

    assert main(["list"]) == 0 and "flagship_recall_rank" in capsys.readouterr().out


def test_data_source(spark):
    spark.dataSource.register(PagedItems)
    df = spark.read.format("paged_items").option("fetcher", "sievelark.sources.plugin:example_pages").option("pages", "3").load()
    assert sorted((r.item_ord, r.title) for r in df.collect())[-1] == (200001, "Item 2-1") and df.count() == 6


def test_fresh_keys(spark, tmp_path):
    rows = [("a", "2026-01-01"), ("a", "2026-01-05"), ("a", "2026-02-20"), ("b", "2026-01-01")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    src = S.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    got = sorted((r.k, str(r.ts)[:10], r.fresh) for r in S.run_once(S.fresh_keys(src, "k", "ts", 30)).collect())
    assert got == [("a", "2026-01-01", True), ("a", "2026-01-05", False), ("a", "2026-02-20", True), ("b", "2026-01-01", True)]


def test_label_file(spark, tmp_path):
    man = {"run_id": "run-1", "papers": [{"item_id": "p01", "semantic_paper_id": "111", "title": "One", "url": "https://a.example/1"}, {"item_id": "p02", "semantic_paper_id": "CorpusId:222", "title": "Two", "url": "https://a.example/2/"}]}
    lab = {"run_id": "run-1", "reviewer": "x", "reviewed_at": "2026-02-21T10:00:00Z", "labels": [
        {"item_id": "p01", "label": "positive", "reviewed_at": "2026-02-21T10:00:00Z"}, {"item_id": "p01", "label": "Negative", "reviewed_at": "2026-02-21T11:00:00Z"}, {"semantic_paper_id": "222", "label": "positive"},
        {"title": " two ", "url": "HTTPS://A.example/2?x=1", "label": "positive"}, {"item_id": "p09", "label": "positive"}, {"item_id": "p01", "label": "bad"}]}
    (tmp_path / "m.json").write_text(json.dumps(man))
    (tmp_path / "l.json").write_text(json.dumps(lab))
    args = (str(tmp_path / "l.json"), str(tmp_path / "m.json"), str(tmp_path / "s"))
    assert pipeline.apply_label_file(spark, *args) == {"entries": 6, "applied": 2, "invalid": 1, "skipped": 1}
    assert {tuple(r) for r in Versioned(spark, str(tmp_path / "s")).read().collect()} == {("CorpusId:111", "negative"), ("CorpusId:222", "positive")}
    lab["labels"] = [{"item_id": "p01", "label": "undecided"}, {"item_id": "p02", "label": "undecided"}]
    (tmp_path / "l.json").write_text(json.dumps(lab))
    pipeline.apply_label_file(spark, *args)
    assert Versioned(spark, str(tmp_path / "s")).read().count() == 0
    for wrong in ({"run_id": "run-2"}, {"reviewer": " "}, {"reviewed_at": ""}):
        (tmp_path / "l.json").write_text(json.dumps(lab | wrong))
        with pytest.raises(ValueError):
            pipeline.apply_label_file(spark, *args)
