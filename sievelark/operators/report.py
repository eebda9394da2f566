"""What a report shows, and the manifest and questionnaire made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import text as X


def shown_links(runs: DataFrame) -> DataFrame:
    """(run_id, pos, href) of every link in a run's report, in order."""
    return runs.select("run_id", F.posexplode(X.hrefs(F.col("report_html"))).alias("pos", "href"))


def visible(items: DataFrame, links: DataFrame, all_if_none: bool = False) -> DataFrame:
    """Items whose normalised address is among the links; with all_if_none every item if there are no links at all."""
    keyed = items.withColumn("href", X.normalize_url(F.col("url")))
    if all_if_none and links.limit(1).isEmpty():
        return keyed
    return keyed.join(links.select("href"), "href", "left_semi")


def manifest(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Entries (run_id, item_id, item_ord, title, url, arxiv_id, semantic_paper_id, feedback_enabled, pos): the items a run shows, numbered p01, p02 ... in the order of first showing.

    Of items with one address the first to arrive is meant."""
    first = shown_links(runs).groupBy("run_id", "href").agg(F.min("pos").alias("at"))
    owner = items.withColumn("href", X.normalize_url(F.col("url"))).groupBy("href").agg(F.min_by(F.struct("item_ord", "title", "url", "arxiv_id", "semantic_paper_id"), "item_ord").alias("i"))
    x = first.join(owner, "href").select("run_id", "at", "i.*")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("at"))
    paper = X.normalize_paper_id(F.col("semantic_paper_id"))
    return x.withColumn("pos", pos).select(
        "run_id", F.format_string("p%02d", "pos").alias("item_id"), "item_ord", X.filled(F.col("title")).alias("title"), X.filled(F.col("url")).alias("url"), X.filled(F.col("arxiv_id")).alias("arxiv_id"),
        F.nullif(paper, F.lit("")).alias("semantic_paper_id"), (paper != "").alias("feedback_enabled"), "pos",
    )


def questionnaire(entries: DataFrame) -> DataFrame:
    """One open question an actionable entry."""
    return entries.where("feedback_enabled").select("run_id", "item_id", F.lit("undecided").alias("label"), F.lit("").alias("note"))


def manifest_documents(entries: DataFrame) -> DataFrame:
    """(run_id, document): the manifest of a run as one JSON text, entries in order. A run's entries are bounded by its report."""
    each = F.struct("pos", F.struct("item_id", "title", "url", "arxiv_id", "semantic_paper_id", "feedback_enabled").alias("e"))
    g = entries.groupBy("run_id").agg(F.array_sort(F.collect_list(each)).alias("l"))
    doc = F.struct(F.lit("v1").alias("version"), F.col("run_id"), F.transform("l", lambda x: x["e"]).alias("papers"))
    return g.select("run_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def decorated(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """report_html with a note behind each link whose address has one (actions: href, note).

    The report is cut at its link ends; the pieces are numbered, joined to the notes and put together again, run by run."""
    cut_at = F.split(F.regexp_replace("report_html", r"(?i)</a\s*>", "</a>\u0001"), "\u0001")
    pieces = runs.select("run_id", F.posexplode(cut_at).alias("k", "piece"))
    target = F.regexp_extract("piece", r"(?is).*<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>.*</a>$", 1)
    pieces = pieces.withColumn("href", X.normalize_url(target))
    joined = pieces.join(actions.select("href", "note"), "href", "left")
    whole = F.concat("piece", F.coalesce("note", F.lit("")))
    g = joined.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("k", whole.alias("p")))).alias("l"))
    return g.select("run_id", F.array_join(F.transform("l", lambda x: x["p"]), "").alias("report_html"))


def keyword_footer(df: DataFrame, most: int = 8, none: str = "AI Research") -> DataFrame:
    """The first distinct matched keywords in order, as one line."""
    words = df.select(F.explode("matched_keywords").alias("w")).distinct()
    return words.orderBy("w").limit(most).agg(F.array_join(F.array_sort(F.collect_list("w")), ", ").alias("_l")).select(F.when(F.col("_l") == "", none).otherwise(F.col("_l")).alias("footer"))


def header(n_papers: Column, n_blogs: Column) -> Column:
    """The line that counts what was reviewed."""
    p, b = F.concat(n_papers.cast("string"), F.lit(" papers")), F.concat(n_blogs.cast("string"), F.lit(" blogs"))
    return F.when((n_blogs > 0) & (n_papers > 0), F.concat(p, F.lit(" + "), b, F.lit(" reviewed"))).when(n_blogs > 0, F.concat(b, F.lit(" reviewed"))).otherwise(F.concat(p, F.lit(" reviewed")))


def wrap_html(content: str, title: str, meta: str) -> str:
    """A page around a report's content."""
    return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{title}</title></head>\n<body><p>{meta}</p>\n{content}\n</body></html>"


def with_head(page: str, extra: str) -> str:
    """The page with `extra` before the first </head>, or in front if there is none."""
    at = page.lower().find("</head>")
    return page[:at] + extra + page[at:] if at >= 0 else extra + page


def after_body(page: str, extra: str) -> str:
    """The page with `extra` behind its first <body ...>, or unchanged if it has none."""
    import re

    m = re.search(r"<body[^>]*>", page, re.I)
    return page[: m.end()] + extra + page[m.end() :] if m else page


def flagged(items: DataFrame, done: DataFrame, name: str = "has_pdf") -> DataFrame:
    """Items with a flag that says whether their identity is in `done` (a column `identity`)."""
    key = F.coalesce(F.nullif(F.col("arxiv_id"), F.lit("")), F.col("url"))
    x = items.withColumn("_i", key).join(done.select(F.col("identity").alias("_i"), F.lit(True).alias("_f")).distinct(), "_i", "left")
    return x.withColumn(name, F.coalesce("_f", F.lit(False))).drop("_i", "_f")
