"""Operators put together: signed links, and the digest from fetched items to ranked ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark import schema
from sievelark.config import Settings
from sievelark.functions import text as X
from sievelark.functions import tokens as K
from sievelark.operators import enrich, memory, rank, recall
from sievelark.session import cut, table


def signed_links(entries: DataFrame, secret: str, base: str, expires: str, reviewer: str = "") -> DataFrame:
    """A signed link for every label of every actionable manifest entry."""
    each = entries.where("feedback_enabled").withColumn("label", F.explode(F.array(*map(F.lit, K.LABELS))))
    claims = K.claims_json(v=F.lit(1), run_id=F.col("run_id"), item_id=F.col("item_id"), semantic_paper_id=F.col("semantic_paper_id"), label=F.col("label"), reviewer=F.lit(reviewer), exp=F.lit(expires))
    out = each.withColumn("token", K.token(claims, secret))
    return out.withColumn("link", K.feedback_url(base, F.col("token")))


def digest(spark: SparkSession, sf_dir: str, include: Sequence[str], exclude: Sequence[str], as_of: Column, ttl_days: int, k: int = 20, with_papers: bool = True) -> dict[str, DataFrame]:
    """The stages of a digest by name: fetched, new (not seen lately; manual items are never held back), unique, recalled, ranked.

    Suppression runs before the dedup, so a suppressed copy does not hide a later one."""
    live = memory.live(table(spark, sf_dir, "semantic_scholar_memory"), as_of, ttl_days)
    fetched = schema.papers(spark, sf_dir).where(F.lit(with_papers))
    manual = F.col("source") == "manual"
    new = memory.suppress(fetched.where(~manual), live).unionByName(fetched.where(manual))
    unique = recall.first_wins(new, recall.identity(), F.col("item_ord"))
    recalled = cut(recall.keyword_recall(unique, include, exclude))
    scored = recalled.withColumns({"relevance_score": F.size("matched_keywords") / 10, "filter_reason": F.array_join("matched_keywords", ",")})
    return {"fetched": fetched, "new": new, "unique": unique, "recalled": recalled, "ranked": rank.ranked(scored, k)}


def funnel(spark: SparkSession, sf_dir: str, include: Sequence[str], exclude: Sequence[str], as_of: Column, ttl_days: int) -> DataFrame:
    """Rows after each stage of the digest."""
    out = None
    for name, df in digest(spark, sf_dir, include, exclude, as_of, ttl_days).items():
        row = df.agg(F.lit(name).alias("stage"), F.count("*").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def run_digest(spark: SparkSession, sf_dir: str, settings: Settings, as_of: Column, scorer: rank.Scorer | None = None, enricher: enrich.Enricher | None = None) -> dict[str, DataFrame]:
    """A whole digest: recalled items, coarse ranking if there are many, signals, fine ranking, posts of the feeds, report lines.

    Signals are looked for only on what the coarse ranking keeps; posts of the feeds skip the filters."""
    scorer = scorer or rank.lexical_scorer(list(settings.include))
    stages = digest(spark, sf_dir, settings.include, settings.exclude, as_of, settings.memory_ttl_days, settings.coarse_keep, settings.with_papers)
    recalled = stages["recalled"]
    if recalled.limit(settings.coarse_threshold + 1).count() > settings.coarse_threshold:
        coarse = cut(rank.ranked(rank.score_with(recalled, scorer, settings.batch_rows), settings.coarse_keep)).drop("relevance_score", "filter_reason")
    else:
        coarse = recalled
    noted = enrich.with_signals(coarse, (enricher or enrich.mock_results)(coarse))
    fine = cut(rank.ranked(rank.score_with(noted, scorer, settings.batch_rows), settings.keep))
    newest = [F.col("fetched_at").desc(), F.col("post_id")]
    since = as_of - F.make_interval(days=F.lit(settings.blog_days))
    posts = recall.recent(recall.first_per_group(table(spark, sf_dir, "blog_posts").where(F.lit(settings.with_blogs)), ["feed_key"], newest, settings.posts_per_feed), "fetched_at", since, keep_undated=True)
    blogs = schema.blog_items(recall.first_wins(posts, F.col("url"), F.col("post_id")))
    lines = recall.numbered(fine, [F.col("relevance_score").desc(), F.col("item_ord")]).select("n", "item_ord", X.report_line(F.col("n"), F.col("title"), F.col("authors"), F.col("url"), F.col("research_notes")).alias("line"))
    return stages | {"coarse": coarse, "fine": fine, "blogs": blogs, "lines": lines}


def apply_files(spark: SparkSession, events: str, manifests: str, seeds: str, dry_run: bool = False) -> dict[str, int]:
    """Folds the pending events of a table into the versioned seeds; returns the counters.

    Nothing is written on a dry run, or if anything fails before the end."""
    from sievelark.operators import feedback
    from sievelark.sources import state

    store = state.Versioned(spark, seeds)
    old = store.read()
    old = spark.createDataFrame([], "paper_id string, polarity string") if old is None else old
    pending = feedback.pending(spark.read.parquet(events))
    entries = state.manifest_entries(state.documents(spark, manifests))
    index = feedback.manifest_index(entries, [F.col("file_rank"), F.col("pos")])
    after, judged = feedback.apply_feedback(pending, index, old, feedback.event_order(pending, F.current_timestamp()))
    after, judged = cut(after), cut(judged)
    out = feedback.counters(judged).first().asDict()
    store.write(after, dry_run)
    sizes = {r.polarity: r["count"] for r in after.groupBy("polarity").count().collect()}
    return out | {"positive": sizes.get("positive", 0), "negative": sizes.get("negative", 0)}


def apply_label_file(spark: SparkSession, labels: str, manifest_path: str, seeds: str, dry_run: bool = False) -> dict[str, int]:
    """Folds one reviewer's label file into the versioned seeds: entries are matched by item, else by paper id, else by title and address; the last of a paper wins."""
    from sievelark.operators import feedback
    from sievelark.operators.recall import known_label
    from sievelark.sources import state

    shown = state.load_object(spark, manifest_path)
    run = str(shown.get("run_id") or "").strip()
    rows = feedback.file_labels(state.load_object(spark, labels), run)
    store = state.Versioned(spark, seeds)
    old = store.read()
    old = spark.createDataFrame([], "paper_id string, polarity string") if old is None else old
    entries = spark.createDataFrame(rows, "item_id string, label string, at string, k int, semantic_paper_id string, title string, url string")
    text = lambda e, k: str(e.get(k) or "").strip()
    known = [(text(e, "item_id"), text(e, "title"), text(e, "url"), text(e, "semantic_paper_id"), i) for i, e in enumerate(shown.get("papers") or [])]
    known = spark.createDataFrame(known, "item_id string, title string, url string, semantic_paper_id string, pos int").withColumn("semantic_paper_id", X.normalize_paper_id(F.col("semantic_paper_id")))
    found = cut(feedback.label_cascade(entries, known).withColumn("known", known_label()))
    good = found.where("known is not null and nullif(paper_id, '') is not null").select("paper_id", F.col("known").alias("label"), "at", "k")
    decided = cut(feedback.latest_labels(good, ["paper_id"], [F.col("at").try_cast("timestamp"), F.col("k")]))
    after = cut(feedback.merge_seeds(old, decided))
    store.write(after, dry_run)
    return {"entries": found.count(), "applied": decided.count(), "invalid": found.where("known is null").count(), "skipped": found.where("known is not null and nullif(paper_id, '') is null").count()}
