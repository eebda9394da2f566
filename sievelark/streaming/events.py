"""Feedback events as a stream.

Rows are landed as files; a stream reads them, drops redelivered events inside the watermark and
folds them into state. With availableNow a stream over all files ends when they are read, and its
result equals the batch operator's."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.operators import feedback
from sievelark.operators.recall import known_label
from sievelark.session import shared_dir, table

LATE = "40 days"


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the parquet files of a folder, or of one file's folder filtered by its name."""
    return spark.readStream.schema(schema).parquet(path)


def unique_events(events: DataFrame, key: str = "event_id", ts: str = "received_at", late: str = LATE) -> DataFrame:
    """Each event once; state is kept for the watermark only."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last event of each key so far (complete or update mode)."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("event_id", "label"), F.struct(*order)).alias("r")).select(key, "r.*")


def windowed(events: DataFrame, ts: str, length: str, late: str = LATE) -> DataFrame:
    """Events by tumbling window and label; late rows are taken in until the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), "label").agg(F.count("*").alias("n_events")).select(F.col("window.start").alias("starts"), "label", "n_events")


def run_once(df: DataFrame, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its output.

    Each micro-batch's output is written to a table in the shared folder; with complete or update output the last batch holds."""
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream_{uuid.uuid4().hex[:12]}"

    def land(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = df.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == last)
    return out.drop("batch")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/feedback_events.parquet"
    stored = table(spark, sf_dir, "feedback_events")
    ntz = [c for c, t in stored.dtypes if t == "timestamp_ntz"]
    raw = source(spark, f"{path}*", stored.schema)
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def winners_of_stream(spark: SparkSession, sf_dir: str, index: DataFrame, now: Column) -> DataFrame:
    """The last valid pending event of each paper, by a stream over all events joined to the manifests' index."""
    events = feedback.resolve_events(feedback.pending(_events(spark, sf_dir)), index).where(known_label().isNotNull())
    return run_once(latest(events, "paper_id", feedback.event_order(events, now)), "complete")


def daily_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and label, each event once: a stream drops redelivered events, a second counts what it wrote, by windows with a watermark."""
    once = run_once(unique_events(_events(spark, sf_dir).select("event_id", "label", "received_at")))
    folder = once.inputFiles()[0].rsplit("/batch=", 1)[0]
    return run_once(windowed(source(spark, f"{folder}/batch=*", once.schema), "received_at", "1 day"), "complete")


def fresh_keys(events: DataFrame, key: str, ts: str, ttl_days: int) -> DataFrame:
    """(key, ts, fresh) of each event: whether its key was not seen in the ttl_days before it.

    A stateful operator: per key the last time is kept and dropped when the ttl has passed in event time."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ttl_ms = ttl_days * 86_400_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(int(t.timestamp() * 1000) for b in batches for t in b[ts])
        last = state.get[0] if state.exists else None
        out = []
        for t in times:
            out.append((k[0], pd.Timestamp(t, unit="ms"), last is None or t - last > ttl_ms))
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, "fresh"])

    schema = f"{key} string, {ts} timestamp, fresh boolean"
    marked = events.withWatermark(ts, f"{ttl_days} days").select(key, ts)
    return marked.groupBy(key).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
