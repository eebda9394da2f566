"""The memory of what was seen: keys with a time, a time to live and a capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import text as X


def item_keys(df: DataFrame) -> Column:
    """The memory keys of an item row: arxiv:<id>; semantic:<id> and <id>; an address only where the source has no better id."""
    arxiv, paper, url = X.normalize_arxiv_id(F.col("arxiv_id")), X.normalize_paper_id(F.col("semantic_paper_id")), X.normalize_url(F.col("url"))
    no_arxiv = arxiv == ""
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)),
                F.when(paper != "", F.concat(F.lit("semantic:"), paper)),
                F.when(paper != "", paper),
                F.when((F.col("source") == "huggingface") & no_arxiv & (url != ""), F.concat(F.lit("hf:"), url)),
                F.when((F.col("source") == "arxiv") & no_arxiv & (url != ""), F.concat(F.lit("arxiv:"), url)),
            )
        )
    )


def live(memory: DataFrame, as_of: Column, ttl_days: int, key: str = "seen", ts: str = "seen_at") -> DataFrame:
    """Entries not older than the time to live, the border included; entries without key or time are dropped."""
    return memory.where((X.strip(F.col(key)) != "") & (F.col(ts) >= as_of - F.make_interval(days=F.lit(ttl_days))))


def seen_flags(items: DataFrame, memory: DataFrame, id_col: str = "item_ord", key: str = "seen") -> DataFrame:
    """The items of which any key is in the (live) memory. Keys are exploded and semi-joined, so no disjunctive join is needed."""
    exploded = items.select(id_col, F.explode(item_keys(items)).alias("_key"))
    return exploded.join(memory.select(F.col(key).alias("_key")), "_key", "left_semi").select(id_col).distinct()


def suppress(items: DataFrame, memory: DataFrame, id_col: str = "item_ord", key: str = "seen") -> DataFrame:
    """The items of which no key is in the memory; items without keys stay."""
    return items.join(seen_flags(items, memory, id_col, key), id_col, "left_anti")


def suppression_stats(items: DataFrame, memory: DataFrame, id_col: str = "item_ord") -> DataFrame:
    flagged = items.select(id_col).join(seen_flags(items, memory, id_col).withColumn("_f", F.lit(1)), id_col, "left")
    return flagged.agg(F.count("*").alias("total"), F.count("_f").alias("suppressed"), (F.count("*") - F.count("_f")).alias("forwarded"))


def upsert(memory: DataFrame, keys: DataFrame, as_of: Column, key: str = "seen", ts: str = "seen_at") -> DataFrame:
    """One entry a key: marked keys get the time as_of, others keep their newest time."""
    new = keys.select(F.col(key), as_of.alias(ts)).distinct()
    return memory.select(key, ts).unionByName(new).groupBy(key).agg(F.max(ts).alias(ts))


def capped(memory: DataFrame, most: int, key: str = "seen", ts: str = "seen_at") -> DataFrame:
    """The newest entries, ties by key; entries without a time go first."""
    return memory.orderBy(F.col(ts).desc_nulls_last(), F.col(key)).limit(most)


def load_json(text: DataFrame, column: str = "value") -> DataFrame:
    """Entries (seen, seen_at) of memory documents {"seen": {key: time}}; invalid documents, blank keys and bad times give none."""
    doc = text.select(F.from_json(column, "struct<seen:map<string,string>,updated_at:string>").alias("d"))
    return doc.select(F.explode("d.seen").alias("seen", "t")).select("seen", F.col("t").try_cast("timestamp").alias("seen_at")).where((X.strip(F.col("seen")) != "") & F.col("seen_at").isNotNull())


def update_from_report(memory: DataFrame, items: DataFrame, shown: DataFrame, sources: list[str], as_of: Column, ttl_days: int) -> DataFrame:
    """Memory after a report: items of the sources that the report shows (urls in `shown.href`) are marked, the rest pruned."""
    eligible = items.where(F.col("source").isin(*sources)).withColumn("href", X.normalize_url(F.col("url")))
    visible = eligible.join(shown.select("href"), "href", "left_semi")
    keys = visible.select(F.explode(item_keys(visible)).alias("seen")).distinct()
    return live(upsert(memory, keys, as_of), as_of, ttl_days)
