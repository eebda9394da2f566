"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sievelark", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, ANSI, adaptive session. `conf` overrides any setting (dots written as `__`)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context, so it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_sievelark_shipped", False):
        return
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="sievelark-")) / "sievelark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._sievelark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; times without zone are read as they are stored."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's `spark.checkpoint.dir`.

    Only where that is unset (tests, one machine) a folder of our own is made."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.environ.get("SIEVELARK_CHECKPOINT_DIR") or os.path.join(tempfile.gettempdir(), "sievelark-checkpoints")
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and stored in the shared folder, so no later step recomputes it
    and a lost executor loses nothing."""
    spark = df.sparkSession
    ship(spark)
    jsc = spark.sparkContext._jsc
    if not jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def list_dir(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any file system; none if there is no such folder."""
    fs, path = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system."""
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zoned or zoneless timestamp (the latter meaning UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def fan_out(df: DataFrame, factor: int = 4) -> DataFrame:
    """Rows in at least `factor` tasks a core, for work that is heavy per row.

    Small inputs arrive as one or two file splits; without this one task does all the work. Inputs
    that the scan already splits finely enough (by the planner's size of them) are left as they
    are: large ones are never shuffled for this."""
    spark = df.sparkSession
    ship(spark)
    want = max(spark.sparkContext.defaultParallelism, 2) * factor
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df if size >= want * split else df.repartition(want)
