"""Streams that run over all that has landed, against the batch result."""

from pyspark.sql import functions as F

from sievelark.streaming import events as S


def test_redelivered_events_count_once(spark, tmp_path):
    rows = [(f"e{i % 7}", f"2026-01-0{1 + i % 3} 00:00:00", "positive") for i in range(7)] + [("e1", "2026-01-02 00:00:00", "positive")] * 3
    df = spark.createDataFrame(rows, "event_id string, t string, label string").withColumn("received_at", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    out = S.run_once(S.unique_events(S.source(spark, str(tmp_path / "in"), df.schema)))
    assert sorted(r.event_id for r in out.collect()) == [f"e{i}" for i in range(7)]


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-01 01:00:00", "x"), ("b", "2026-01-01 23:00:00", "x"), ("c", "2026-01-02 01:00:00", "y")], "event_id string, t string, label string").withColumn("received_at", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    out = S.run_once(S.windowed(S.source(spark, str(tmp_path / "in"), df.schema), "received_at", "1 day"), "complete")
    assert sorted((str(r.starts)[:10], r.label, r.n_events) for r in out.collect()) == [("2026-01-01", "x", 2), ("2026-01-02", "y", 1)]
