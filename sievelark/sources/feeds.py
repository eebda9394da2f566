"""Item sources: feed documents and service answers as stored text, read into the item schema.

Fetching is left to whoever lands the documents; a document that cannot be read gives no items and
is found in `rejects`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import text as X
from sievelark.schema import AUTHORS, conform

_ATOM_ENTRY = (
    "struct<id:string,title:string,summary:string,published:string,updated:string,"
    "author:array<struct<name:string,`arxiv:affiliation`:string>>,category:array<struct<_term:string>>,link:array<struct<_href:string,_title:string,_rel:string>>>"
)
_ATOM = f"entry array<{_ATOM_ENTRY}>"
_RSS_ITEM = "struct<title:string,link:string,pubDate:string,description:string,`content:encoded`:string,`dc:creator`:string,author:string>"
#: Characters kept of a post's full content, and the note behind them.
FULL, FULL_NOTE = 2000, "... [Content truncated to save tokens]"
_RSS = f"channel struct<title:string,item:array<{_RSS_ITEM}>>"


def one_line(c: Column) -> Column:
    """Line breaks made spaces, ends stripped."""
    return X.strip(F.regexp_replace(c, "\n", " "))


def atom_items(docs: DataFrame, column: str = "value") -> DataFrame:
    """Items of Atom documents, with pdf_url and updated; the id is what follows /abs/ in the entry's id."""
    e = docs.withColumn("_ord", F.monotonically_increasing_id()).select("_ord", F.posexplode(F.from_xml(column, _ATOM)["entry"]).alias("_pos", "e"))
    authors = F.transform("e.author", lambda a: F.struct(a["name"].alias("name"), a["arxiv:affiliation"].alias("affiliation"), F.lit(None).cast("string").alias("email")))
    pdf = F.filter("e.link", lambda x: x["_title"] == "pdf")
    return e.select(
        (F.col("_ord") * 100_000 + F.col("_pos")).alias("item_ord"), one_line(F.col("e.title")).alias("title"), one_line(F.col("e.summary")).alias("abstract"), F.col("e.id").alias("url"), F.lit("arxiv").alias("source"),
        F.substring_index("e.id", "/abs/", -1).alias("arxiv_id"), F.lit(None).cast("string").alias("semantic_paper_id"), F.col("e.published").alias("published_date"), authors.cast(AUTHORS).alias("authors"),
        F.transform("e.category", lambda c: c["_term"]).alias("categories"), F.get(pdf, F.lit(0))["_href"].alias("pdf_url"), F.col("e.updated").alias("updated_date"),
    )


def rss_posts(docs: DataFrame, column: str = "value", key: str = "feed_key", most: int = 5, shortened: int = 1500) -> DataFrame:
    """Posts of RSS documents (feed_key, value): the first `most` entries of a feed, the summary before the full content (of that FULL characters and a note), text without markup and shortened."""
    e = docs.select(key, F.posexplode(F.slice(F.from_xml(column, _RSS)["channel"]["item"], 1, most)).alias("pos", "e"))
    body = F.coalesce(X.filled(F.col("e.description")), X.truncate_marked(X.filled(F.col("e.content:encoded")), FULL, FULL_NOTE), F.lit(""))
    return e.select(
        key, "pos", X.strip(F.col("e.title")).alias("title"), X.truncate_marked(X.strip_html(body), shortened).alias("content"), F.col("e.link").alias("url"),
        F.col("e.pubDate").alias("published_date"), F.coalesce(X.filled(F.col("e.dc:creator")), X.filled(F.col("e.author"))).alias("author"),
    )


_DAILY = "array<struct<paper:struct<id:string,title:string,summary:string,publishedAt:string,authors:array<struct<name:string>>>,publishedAt:string>>"


def daily_items(docs: DataFrame, column: str = "value", host: str = "https://arxiv.example/abs/") -> DataFrame:
    """Items of a daily list in JSON; the address is made from the id."""
    e = docs.withColumn("_ord", F.monotonically_increasing_id()).select("_ord", F.posexplode(F.from_json(column, _DAILY)).alias("_pos", "e"))
    p = F.col("e.paper")
    return conform(
        e.where(X.strip(p["id"]) != "").select(
            (F.col("_ord") * 100_000 + F.col("_pos")).alias("item_ord"), one_line(p["title"]).alias("title"), one_line(p["summary"]).alias("abstract"), F.concat(F.lit(host), p["id"]).alias("url"), F.lit("huggingface").alias("source"), p["id"].alias("arxiv_id"),
            F.coalesce(p["publishedAt"], F.col("e.publishedAt")).alias("published_date"), F.transform(p["authors"], lambda a: F.struct(a["name"].alias("name"), F.lit(None).cast("string").alias("affiliation"), F.lit(None).cast("string").alias("email"))).alias("authors"),
        )
    )


_RECOMMENDED = "recommendedPapers array<struct<paperId:string,title:string,abstract:string,year:int,url:string,externalIds:struct<ArXiv:string>,authors:array<struct<name:string>>>>"


def recommended_items(docs: DataFrame, column: str = "value", host: str = "https://arxiv.example/abs/") -> DataFrame:
    """Items of a recommendation answer: at most 20 authors, then those with a name; a year is its first of January."""
    e = docs.withColumn("_ord", F.monotonically_increasing_id()).select("_ord", F.posexplode(F.from_json(column, _RECOMMENDED)["recommendedPapers"]).alias("_pos", "e"))
    names = F.filter(F.slice(F.coalesce("e.authors", F.array().cast("array<struct<name:string>>")), 1, 20), lambda a: X.strip(a["name"]) != "")
    arxiv = X.filled(F.col("e.externalIds.ArXiv"))
    return conform(
        e.where(X.strip(F.col("e.title")) != "").select(
            (F.col("_ord") * 100_000 + F.col("_pos")).alias("item_ord"), X.strip(F.col("e.title")).alias("title"), X.strip(F.col("e.abstract")).alias("abstract"),
            F.coalesce(F.concat(F.lit(host), arxiv), F.col("e.url"), F.lit("")).alias("url"), F.lit("semantic_scholar").alias("source"), arxiv.alias("arxiv_id"), X.normalize_paper_id(F.col("e.paperId")).alias("semantic_paper_id"),
            F.when(F.col("e.year") > 0, F.format_string("%04d-01-01", "e.year")).alias("published_date"),
            F.transform(names, lambda a: F.struct(X.strip(a["name"]).alias("name"), F.lit(None).cast("string").alias("affiliation"), F.lit(None).cast("string").alias("email"))).alias("authors"),
        )
    )


def manual_items(docs: DataFrame, column: str = "value") -> DataFrame:
    """Items of {"papers": [...]}: objects as they are, address strings as place holders with the id found in them."""
    v = docs.withColumn("_ord", F.monotonically_increasing_id()).select("_ord", F.try_parse_json(column).alias("v"))
    e = v.select("_ord", F.posexplode(F.try_variant_get("v", "$.papers", "array<variant>")).alias("_pos", "x"))
    get = lambda k: F.try_variant_get("x", f"$.{k}", "string")
    text = F.try_variant_get("x", "$", "string")
    is_text = F.schema_of_variant("x") == "STRING"
    found = X.filled(X.arxiv_id_of_url(text))
    return conform(
        e.select(
            (F.col("_ord") * 100_000 + F.col("_pos")).alias("item_ord"), F.when(is_text, F.lit("[Metadata not fetched]")).otherwise(get("title")).alias("title"), F.when(is_text, F.lit("")).otherwise(get("abstract")).alias("abstract"),
            F.when(is_text, text).otherwise(get("url")).alias("url"), F.when(is_text, F.lit("manual")).otherwise(F.coalesce(get("source"), F.lit("manual"))).alias("source"), F.when(is_text, found).otherwise(get("arxiv_id")).alias("arxiv_id"),
            F.when(~is_text, get("semantic_paper_id")).alias("semantic_paper_id"), F.when(~is_text, get("published_date")).alias("published_date"),
        ).where("title is not null and url is not null")
    )


def page_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """Items of plain page texts (url, value): the first line is the title, 2000 characters the body."""
    first = F.substring_index(X.strip(F.col(column)), "\n", 1)
    rest = X.strip(F.substring(X.strip(F.col(column)), F.length(first) + 1, F.lit(2**30)))
    return conform(pages.select(F.monotonically_increasing_id().alias("item_ord"), F.left(first, F.lit(100)).alias("title"), F.left(rest, F.lit(2000)).alias("abstract"), "url", F.lit("manual").alias("source"), F.lit(True).alias("skip_filter")))


def seed_ids(doc: DataFrame, column: str = "value") -> DataFrame:
    """(paper_id, polarity) of {"positive_paper_ids": [...], "negative_paper_ids": [...]}; anything unreadable gives none."""
    d = F.from_json(column, "struct<positive_paper_ids:array<string>,negative_paper_ids:array<string>>")

    def side(name: str) -> DataFrame:
        ids = doc.select(F.explode(d[f"{name}_paper_ids"]).alias("i")).where(X.strip(F.col("i")) != "")
        s = X.strip(F.col("i"))
        return ids.select(F.when(s.contains(":"), s).otherwise(X.normalize_paper_id(s)).alias("paper_id"), F.lit(name).alias("polarity"))

    return side("positive").unionByName(side("negative"))


def rejects(docs: DataFrame, column: str, schema: str, xml: bool = False) -> DataFrame:
    """The documents that cannot be read at all."""
    read = F.from_xml(column, schema) if xml else F.from_json(column, schema)
    return docs.where(F.col(column).isNotNull() & read.isNull())
