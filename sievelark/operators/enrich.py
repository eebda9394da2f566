"""Community signals for items: search results to notes, by a pluggable enricher."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelark.functions import text as X


class Enricher(Protocol):
    """Returns (item_ord, results array<struct<title,url,content>>) for items."""

    def __call__(self, items: DataFrame) -> DataFrame: ...


def mock_results(items: DataFrame) -> DataFrame:
    """The deterministic default: results made of the item itself, of the site its number picks."""
    site = F.element_at(F.array(*[F.lit(x) for x in ("https://github.com/a/b", "https://www.reddit.com/r/x", "https://twitter.com/x", "https://huggingface.co/x", "https://else.example/")]), (F.col("item_ord") % 5 + 1).cast("int"))
    content = F.when(F.col("item_ord") % 3 == 0, F.concat((F.col("item_ord") * 1000).cast("string"), F.lit(" stars"))).otherwise(F.coalesce("abstract", F.lit("")))
    one = F.struct(F.coalesce("title", F.lit("")).alias("title"), site.alias("url"), content.alias("content"))
    two = F.struct(F.lit("card").alias("title"), F.lit("https://huggingface.co/y").alias("url"), F.lit("").alias("content"))
    return items.select("item_ord", F.when(F.col("item_ord") % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("results"))


def with_signals(items: DataFrame, results: DataFrame) -> DataFrame:
    """research_notes of every item; items without results say that none were found."""
    r = results.select("item_ord", X.signals(F.col("results")).alias("research_notes"))
    return items.join(r, "item_ord", "left").withColumn("research_notes", F.coalesce("research_notes", F.lit(X.NO_SIGNAL)))
