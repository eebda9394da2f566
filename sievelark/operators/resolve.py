"""Finding an item's paper id: existing id, lookup by id, lookup by title, under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import text as X


def title_matches(items: DataFrame, catalogue: DataFrame, years: int = 1) -> DataFrame:
    """(id, match_id): for each item the lowest catalogue id, other than its own, of equal match title that is also near in year or shares an author.

    items and catalogue: id, title, year, authors (array of names). The catalogue is reduced to the two
    lowest ids of each title and year, and of each title and author, before items are joined to it on these
    keys; so a title that very many rows share makes no pairs of all of them."""
    key = lambda df: df.select("id", "year", "authors", X.match_title(F.col("title")).alias("_k")).where("_k <> ''")
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), X.match_title), lambda n: n != "")
    tags = lambda ys: F.explode(F.array_distinct(F.concat(ys, F.transform(names, lambda n: F.concat(F.lit("a "), n)))))
    year = lambda d: F.concat(F.lit("y "), (F.col("year") + d).cast("string"))
    known = key(catalogue).select("id", "_k", tags(F.array_compact(F.array(year(0)))).alias("_t"))
    first = known.groupBy("_k", "_t").agg(F.min("id").alias("_1"))
    second = known.join(first, ["_k", "_t"]).where(F.col("id") > F.col("_1")).groupBy("_k", "_t").agg(F.min("id").alias("_2"))
    lowest = first.join(second, ["_k", "_t"], "left")
    asked = key(items).select("id", "_k", tags(F.array_compact(F.array(*[year(d) for d in range(-years, years + 1)]))).alias("_t"))
    hit = asked.join(lowest, ["_k", "_t"]).select("id", F.when(F.col("_1") != F.col("id"), F.col("_1")).otherwise(F.col("_2")).alias("m"))
    return hit.where("m is not null").groupBy("id").agg(F.min("m").alias("match_id"))


def within_budget(keys: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """Distinct lookup keys with in_budget: the first `most` by a total order may be looked up.

    Ranks come from one top-k, not from a global window."""
    first = keys.orderBy(*order).limit(most).withColumn("_in", F.lit(True))
    cols = keys.columns
    return keys.join(first, cols, "left").select(*cols, F.coalesce("_in", F.lit(False)).alias("in_budget"))


#: Sources whose items are looked up, and most lookups without an access key.
LOOKED_UP, KEYLESS = ("arxiv", "huggingface"), 10


def resolve(items: DataFrame, by_arxiv: DataFrame, by_title: DataFrame, budget: int | None = None, has_key: bool = True) -> DataFrame:
    """paper_id, status, method and error of each item (item_ord, title, url, source, arxiv_id, semantic_paper_id).

    by_arxiv: (arxiv_key, found_id, failed); a failed lookup ends the search. by_title: (item_ord, found_id).
    Items of sources that are not looked up stay unresolved unless they have an id. Each distinct key is looked
    up once, at the first item that has it (`asked`); with a budget (KEYLESS at most without a key), keys
    beyond it in the order of those items are errors."""
    own = X.normalize_paper_id(F.col("semantic_paper_id"))
    x = items.withColumns({"_own": F.nullif(own, F.lit("")), "_a": F.nullif(X.normalize_arxiv_id(F.col("arxiv_id")), F.lit("")), "lookup_key": X.cache_key(F.col("arxiv_id"), F.col("title"), F.col("url"))})
    looked = F.col("_own").isNull() & F.lower(X.strip(F.col("source"))).isin(*LOOKED_UP)
    wanted = x.where(looked).groupBy("lookup_key").agg(F.min("item_ord").alias("_first"))
    if budget is not None:
        most = budget if has_key else min(budget, KEYLESS)
        x = x.join(within_budget(wanted, most, [F.col("_first"), F.col("lookup_key")]), "lookup_key", "left")
    else:
        x = x.join(wanted, "lookup_key", "left").withColumn("in_budget", F.lit(True))
    x = x.join(by_arxiv.select(F.col("arxiv_key").alias("_a"), F.col("found_id").alias("_fa"), "failed"), "_a", "left")
    x = x.join(by_title.groupBy("item_ord").agg(F.min("found_id").alias("_ft")), "item_ord", "left")
    over = looked & ~F.coalesce("in_budget", F.lit(True))
    failed = F.coalesce("failed", F.lit(False))
    status = F.when(F.col("_own").isNotNull(), "existing").when(~looked, "unresolved").when(over | failed, "error").when(F.coalesce("_fa", "_ft").isNotNull(), "resolved").otherwise("unresolved")
    method = F.when(F.col("_own").isNotNull(), "existing").when(over | ~looked, "none").when(failed | F.col("_fa").isNotNull(), "arxiv").when(F.col("_ft").isNotNull(), "title_search").otherwise("none")
    found = F.when(status == "existing", F.col("_own")).when(status == "resolved", F.coalesce("_fa", "_ft"))
    asked = F.when(looked, F.col("item_ord") == F.col("_first"))
    return x.select("item_ord", "lookup_key", found.alias("paper_id"), status.alias("status"), method.alias("method"), F.when(over, "budget_exhausted").alias("error"), asked.alias("asked"))


def stats(resolved: DataFrame) -> DataFrame:
    """The six counters of a run: an item over the budget counts as unresolved where its key comes first, and as an error where that answer is used again."""
    first, over = F.coalesce("asked", F.lit(False)), F.col("error").isNotNull()
    return resolved.agg(
        F.count_if(F.col("status").isin("existing", "resolved")).alias("resolved"), F.count_if((F.col("status") == "unresolved") | (over & first)).alias("unresolved"), F.count_if((F.col("status") == "error") & ~(over & first)).alias("errors"),
        F.count_if(~F.col("asked")).alias("cache_hits"), F.count_if(first & ~over).alias("lookups"), F.count_if(first & over).alias("budget_skips"),
    )
