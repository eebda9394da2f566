"""Filters and keyword recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions.text import filled
from sievelark.session import cut


def searched(title: str = "title", abstract: str = "abstract") -> Column:
    """Title and abstract in lower case, empty parts left out."""
    return F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit(""))))


def keyword_recall(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), text: Column | None = None) -> DataFrame:
    """Rows whose text holds a keyword and no excluded one; matched_keywords lists the matches in the given order, repeats kept.

    Keywords match as substrings in any letter case. Without keywords rows pass; matched_keywords is then
    left as it is, or empty. The text is lowered once a row; keywords are constants of the plan."""
    df = df.withColumn("_text", text if text is not None else searched())
    if exclude:
        df = df.where(~F.exists(F.array(*[F.lit(k.lower()) for k in exclude]), lambda k: F.col("_text").contains(k)))
    if include:
        hit = F.array_compact(F.array(*[F.when(F.col("_text").contains(k.lower()), F.lit(k)) for k in include]))
        df = df.withColumn("matched_keywords", hit).where(F.size("matched_keywords") > 0)
    elif "matched_keywords" not in df.columns:
        df = df.withColumn("matched_keywords", F.array().cast("array<string>"))
    return df.drop("_text")


def recent(df: DataFrame, ts: str, cutoff: Column, keep_undated: bool = False) -> DataFrame:
    """Rows not older than the cutoff, the cutoff included; undated rows only if asked."""
    old = F.col(ts) >= cutoff
    return df.where(F.col(ts).isNull() | old if keep_undated else old)


def from_sources(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    return df.where(F.col("source").isin(*sources))


def routed(df: DataFrame) -> DataFrame:
    """route: blog, direct (skips the filters) or filtered."""
    return df.withColumn("route", F.when(F.coalesce("is_blog", F.lit(False)), "blog").when(F.coalesce("skip_filter", F.lit(False)), "direct").otherwise("filtered"))


def gated(df: DataFrame, threshold: int, k: int, order: Sequence[Column]) -> DataFrame:
    """All rows if there are at most `threshold`, else the first k by `order`.

    The count stops after threshold + 1 rows."""
    return df if df.limit(threshold + 1).count() <= threshold else df.orderBy(*order).limit(k)


def identity(arxiv_id: str = "arxiv_id", url: str = "url") -> Column:
    """What makes two rows one row: the stored id, else the address."""
    return F.coalesce(F.nullif(F.col(arxiv_id), F.lit("")), F.col(url))


def first_wins(df: DataFrame, key: Column, order: Sequence[Column] | Column) -> DataFrame:
    """The first row of each key; rows without a key are one group.

    One aggregate with map-side combine (min of the order and the row), no sort of a hot key."""
    order = [order] if isinstance(order, Column) else list(order)
    rest = [c for c in df.columns]
    g = df.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select("_r.*")


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows by a total order."""
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank `rn`; partial ranks cut each task's rows before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n") -> DataFrame:
    """Numbers rows from 1 by a total order without bringing them into one task: range partitions are counted, then offset."""
    from pyspark.sql import Window

    spread = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return spread.join(F.broadcast(offsets), "_p").withColumn(name, (local + F.col("_o")).cast("bigint")).drop("_p", "_o")


def known_label(label: str = "label", allowed: Sequence[str] = ("positive", "negative", "undecided")) -> Column:
    """The label in its plain form, or null if it is none of the allowed."""
    s = F.lower(filled(F.col(label)))
    return F.when(s.isin(*allowed), s)
