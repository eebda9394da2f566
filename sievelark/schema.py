"""The one schema of items from all sources, and how the stored tables are read into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.functions import text as X
from sievelark.session import table

AUTHORS = "array<struct<name:string,affiliation:string,email:string>>"
ITEM = {
    "item_ord": "bigint", "title": "string", "abstract": "string", "url": "string", "source": "string", "arxiv_id": "string", "semantic_paper_id": "string", "published_date": "string",
    "authors": AUTHORS, "categories": "array<string>", "is_blog": "boolean", "skip_filter": "boolean", "blog_source": "string", "notes": "string",
}
#: Sources an item may have.
SOURCES = ("arxiv", "semantic_scholar", "huggingface", "openreview", "manual")
#: How blog posts become items.
BLOG_ABSTRACT, BLOG_NOTE = 2000, "From: "


def conform(df: DataFrame) -> DataFrame:
    """Exactly the item columns, missing ones null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in ITEM.items()])


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(table(spark, sf_dir, "papers").withColumns({"is_blog": F.lit(False), "skip_filter": F.lit(False)}))


def blog_items(posts: DataFrame) -> DataFrame:
    """Blog posts as items: marked title, shortened content, source manual, priority ones skip the filters."""
    return conform(
        posts.select(
            F.col("post_id").alias("item_ord"), X.blog_title(F.col("title")).alias("title"), F.left(F.coalesce("content", F.lit("")), F.lit(BLOG_ABSTRACT)).alias("abstract"), "url",
            F.lit("manual").alias("source"), "published_date", F.when(X.filled(F.col("author")).isNotNull(), F.array(F.struct(F.col("author").alias("name"), F.lit(None).cast("string").alias("affiliation"), F.lit(None).cast("string").alias("email")))).otherwise(F.array().cast(AUTHORS)).alias("authors"),
            F.lit(True).alias("is_blog"), F.col("priority").alias("skip_filter"), F.col("source_name").alias("blog_source"), F.concat(F.lit(BLOG_NOTE), F.col("source_name")).alias("notes"),
        )
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; `arrival` orders them as if the parts came one after another, each by item_ord."""
    out = None
    for rank, p in enumerate(parts):
        p = conform(p).withColumn("arrival", F.struct(F.lit(rank).alias("rank"), F.col("item_ord").alias("pos")))
        out = p if out is None else out.unionByName(p)
    return out
