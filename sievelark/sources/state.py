"""State on files: JSON documents, manifests of many runs, versioned tables, queues, attachments."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.functions import text as X
from sievelark.functions.tokens import LABELS


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of whole files; a pattern may match many."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def load_object(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """One JSON object: without a default a missing or unreadable file or another kind of value is an error."""
    try:
        if not exists(spark, path):
            raise FileNotFoundError(path)
        got = json.loads(documents(spark, path).first().value)
        if not isinstance(got, dict):
            raise ValueError(f"{path} holds no JSON object")
        return got
    except (FileNotFoundError, ValueError):
        if default is None:
            raise
        return default


_MANIFEST = "run_id string, papers array<struct<item_id:string,title:string,url:string,arxiv_id:string,semantic_paper_id:string>>"


def manifest_entries(docs: DataFrame, first_file: str | None = None) -> DataFrame:
    """(run_id, item_id, semantic_paper_id, title, url, file_rank, pos) of manifest documents; unreadable ones give none.

    Files count in the order of their names, an explicitly named one before all; later files overwrite (see feedback.manifest_index)."""
    m = docs.select("file", F.from_json("value", _MANIFEST).alias("m")).where("m.run_id is not null")
    rank = F.struct((F.col("file") != F.lit(first_file or "")).cast("int").alias("named"), F.col("file"))
    return m.select("m.run_id", F.posexplode("m.papers").alias("pos", "p"), rank.alias("file_rank")).select("run_id", "p.item_id", "p.semantic_paper_id", "p.title", "p.url", "file_rank", "pos")


class Versioned:
    """A table as numbered version folders and a pointer file: a reader never sees half a version, and what is read is never overwritten."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def current(self) -> str | None:
        if not exists(self.spark, f"{self.base}/CURRENT"):
            return None
        return self.spark.read.text(f"{self.base}/CURRENT").first().value

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(f"{self.base}/{at}")

    def write(self, df: DataFrame, dry_run: bool = False) -> str | None:
        """Writes a version, then moves the pointer; with dry_run nothing."""
        if dry_run:
            return None
        name = f"v_{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.base}/{name}")
        p, fs = _path(self.spark, f"{self.base}/CURRENT.{name}")
        out = fs.create(p, True)
        out.write(bytearray(name.encode()))
        out.close()
        target, _ = _path(self.spark, f"{self.base}/CURRENT")
        fs.delete(target, False)
        fs.rename(p, target)
        return name


def upsert(table: DataFrame | None, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key, new ones in place of old."""
    if table is None:
        return rows
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in table.columns if c not in key]), "_new").alias("_r")).select(*key, "_r.*")


def update_status(events: DataFrame, judged: DataFrame, as_of: Column) -> DataFrame:
    """Events with status, paper id, time and error of those that came to an end; blank event ids are left alone."""
    new = judged.where(X.strip(F.col("event_id")) != "").select("event_id", F.col("outcome").alias("_s"), F.col("paper_id").alias("_p"), F.col("reason").alias("_e"))
    x = events.join(new, "event_id", "left")
    done = F.col("_s").isNotNull()
    return x.withColumns({
        "status": F.coalesce("_s", "status"), "resolved_semantic_paper_id": F.coalesce("_p", "resolved_semantic_paper_id"),
        "applied_at": F.when(done & (F.col("_s") == "applied"), as_of.cast("string")).otherwise(F.col("applied_at")), "error": F.when(done, F.col("_e")).otherwise(F.col("error")),
    }).select(*events.columns)


def queue_event(spark: SparkSession, path: str, run_id: str, item_id: str, label: str, reviewer: str, created_at: str, source: str = "email_link") -> str:
    """Appends one pending event to a queue folder and returns its id; an unknown label is an error."""
    label = (label or "").strip().lower()
    if label not in LABELS:
        raise ValueError(f"label must be one of {', '.join(LABELS)}")
    key = f"evt_{uuid.uuid4().hex}"
    row = [(key, run_id, item_id, label, reviewer, created_at, source, "pending")]
    spark.createDataFrame(row, "event_id string, run_id string, item_id string, label string, reviewer string, created_at string, source string, status string").coalesce(1).write.mode("append").json(path)
    return key


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, is_pdf, encoded) of binary files: base64 of those that start with the PDF magic, null for others."""
    ok = F.startswith(F.col("content"), F.unhex(F.lit("25504446")))
    return files.select("path", ok.alias("is_pdf"), F.when(ok, F.base64("content")).alias("encoded"))


def attachments(files: DataFrame) -> DataFrame:
    """(filename, content) of binary files, the content in base64."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.base64("content").alias("content"))
