"""The core queries: name -> callable(spark, sf_dir). Each runs an operator over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelark import schema
from sievelark.functions import text as X
from sievelark.functions import tokens as K
from sievelark.operators import enrich, feedback, instants, memory, rank, recall, report, resolve, vectors
from sievelark.plans import pipeline
from sievelark.session import table
from sievelark.streaming import events as stream

#: Parameters of the queries; the SQL twins in `oracles` use the same.
INCLUDE = ["retrieval", "alignment", "Reasoning", "calibration", "planning", "alignment"]
EXCLUDE = ["jailbreaks", "watermarks"]
AS_OF = "2025-06-30 00:00:00"
TTL_DAYS, CAP = 120, 500
SECRET = "not a secret"
BASE = "https://feedback.example/"

QUERIES: dict = {}
ts = lambda s: F.lit(s).cast("timestamp_ntz")
n_ = lambda c="*": F.count(c).cast("bigint")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _papers(s: SparkSession, d: str) -> DataFrame:
    return schema.papers(s, d)


def _posts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "blog_posts")


def _events(s: SparkSession, d: str) -> DataFrame:
    """Feedback events, redelivered copies once."""
    return table(s, d, "feedback_events").dropDuplicates(["event_id"])


def _memory(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_scholar_memory")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feedback_runs")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return report.manifest(_runs(s, d), _papers(s, d))


def _pending(s: SparkSession, d: str) -> DataFrame:
    return feedback.pending(_events(s, d))


def _order() -> list[Column]:
    return [X.iso_time(F.col("created_at"), F.lit(AS_OF)), F.col("event_id")]


def _index(s: SparkSession, d: str) -> DataFrame:
    return feedback.manifest_index(_manifest(s, d), F.col("pos"))


# --- recall, filters, dedup -------------------------------------------------------------


@query
def flagship_recall_rank(s, d):
    unique = recall.first_wins(_papers(s, d).select("item_ord", "title", "abstract", "arxiv_id", "url"), recall.identity(), F.col("item_ord"))
    hit = recall.keyword_recall(unique, INCLUDE, EXCLUDE)
    out = hit.select("item_ord", "title", F.array_join("matched_keywords", ",").alias("keywords"), F.size("matched_keywords").cast("bigint").alias("n"))
    return recall.top_k(out, 20, [F.col("n").desc(), F.col("item_ord")])


@query
def keyword_recall(s, d):
    hit = recall.keyword_recall(_papers(s, d), INCLUDE)
    return hit.select("item_ord", F.array_join("matched_keywords", ",").alias("keywords"))


@query
def keyword_exclude(s, d):
    return recall.keyword_recall(_papers(s, d), [], EXCLUDE).select("item_ord", F.size("matched_keywords").cast("bigint").alias("n"))


@query
def recency_filter(s, d):
    return recall.recent(table(s, d, "papers"), "fetched_at", ts("2025-02-01 00:00:00")).select("item_ord", "fetched_at")


@query
def recency_undated_kept(s, d):
    docs = table(s, d, "documents")
    return recall.recent(docs, "collected_at", ts("2025-02-01 00:00:00"), keep_undated=True).select("doc_id", "collected_at")


@query
def dedup_first_wins(s, d):
    return recall.first_wins(_papers(s, d).select("item_ord", "arxiv_id", "url", "source"), recall.identity(), F.col("item_ord"))


@query
def blog_dedup(s, d):
    return recall.first_wins(_posts(s, d).select("post_id", "url", "feed_key"), F.col("url"), F.col("post_id"))


@query
def union_sources(s, d):
    u = schema.union_sources(schema.blog_items(_posts(s, d)), _papers(s, d))
    return u.select(F.col("arrival.rank").cast("bigint").alias("rank"), "item_ord", "title", "source", "is_blog", "blog_source", "notes")


@query
def blog_to_item(s, d):
    return schema.blog_items(_posts(s, d)).select("item_ord", "title", "abstract", "source", "notes", "skip_filter", F.size("authors").cast("bigint").alias("n_authors"))


@query
def source_routing(s, d):
    u = schema.union_sources(schema.blog_items(_posts(s, d)), _papers(s, d))
    return recall.routed(u).groupBy("route", "source").agg(n_().alias("n_rows"))


@query
def eligible_by_source(s, d):
    return recall.from_sources(_papers(s, d), ["semantic_scholar", "arxiv", "huggingface"]).groupBy("source").agg(n_().alias("n_rows"))


@query
def first_posts_per_feed(s, d):
    newest = [F.col("fetched_at").desc(), F.col("post_id")]
    return recall.recent(recall.first_per_group(_posts(s, d), ["feed_key"], newest, 5), "fetched_at", ts("2025-03-01 00:00:00"), True).select("feed_key", F.col("rn").cast("bigint").alias("rn"), "post_id")


@query
def threshold_gate(s, d):
    return recall.gated(_papers(s, d).select("item_ord", "source"), 50, 20, [F.col("item_ord")])


@query
def head_without_sort(s, d):
    return _papers(s, d).select("item_ord", "title").orderBy("item_ord").limit(15)


@query
def enabled_feeds(s, d):
    feeds = table(s, d, "blog_feeds")
    enabled = feeds.where("priority").select("feed_key")
    return _posts(s, d).join(enabled, "feed_key", "left_semi").groupBy("feed_key").agg(n_().alias("n_posts"))


@query
def priority_counts(s, d):
    return _posts(s, d).agg(F.count_if("priority").alias("n_priority"), F.count_if(~F.col("priority")).alias("n_normal"))


# --- scalar functions -------------------------------------------------------------------


@query
def url_normalize(s, d):
    u = _papers(s, d).select("url").unionByName(_posts(s, d).select("url"))
    return u.select("url", X.normalize_url(F.col("url")).alias("norm")).distinct()


@query
def id_normalize(s, d):
    return _papers(s, d).select("item_ord", X.normalize_paper_id(F.col("semantic_paper_id")).alias("paper_id"), X.normalize_arxiv_id(F.col("arxiv_id")).alias("arxiv_key"))


@query
def arxiv_id_from_url(s, d):
    return _papers(s, d).select("item_ord", X.arxiv_id_of_url(F.col("url")).alias("found"))


@query
def title_normalize(s, d):
    return _papers(s, d).select("item_ord", X.spaced_title(F.col("title")).alias("spaced"), X.match_title(F.col("title")).alias("matched"))


@query
def href_extract(s, d):
    return report.shown_links(_runs(s, d)).select("run_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query
def html_strip(s, d):
    return _posts(s, d).select("post_id", X.strip_html(F.col("content")).alias("plain"))


@query
def truncate_marker(s, d):
    return _posts(s, d).select("post_id", X.truncate_marked(X.strip_html(F.col("content")), 300).alias("short"))


@query
def three_sentences(s, d):
    return _papers(s, d).where("abstract is not null").select("item_ord", X.first_sentences(F.col("abstract")).alias("summary"))


@query
def search_query(s, d):
    return _papers(s, d).select("item_ord", X.search_query(F.col("title")).alias("q"))


@query
def signal_extract(s, d):
    return enrich.with_signals(_papers(s, d).select("item_ord"), enrich.mock_results(_papers(s, d))).select("item_ord", "research_notes")


@query
def b64url(s, d):
    return _papers(s, d).select("item_ord", K.b64url(F.col("title").cast("binary")).alias("coded"), K.unb64url(K.b64url(F.col("title").cast("binary"))).cast("string").alias("back"))


@query
def feedback_token(s, d):
    return pipeline.signed_links(_manifest(s, d), SECRET, BASE, "2025-12-31T00:00:00Z").select("run_id", "item_id", "label", "token", "link")


@query
def token_verify(s, d):
    links = pipeline.signed_links(_manifest(s, d), SECRET, BASE, "2025-12-31T00:00:00Z")
    broken = F.when(F.col("label") == "negative", F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    v = links.withColumn("v", K.verify(broken, SECRET, F.lit(AS_OF).cast("timestamp")))
    return v.groupBy(F.col("v.error").alias("error"), F.col("v.claims.label").alias("label")).agg(n_().alias("n_tokens"))


@query
def run_view_url(s, d):
    return _runs(s, d).select("run_id", K.run_view_url(BASE, F.col("run_id")).alias("view_url"))


@query
def run_id_format(s, d):
    return table(s, d, "papers").select("item_ord", X.run_id(F.col("fetched_at")).alias("run"), X.iso_utc(F.col("fetched_at")).alias("iso"))


@query
def chinese_date(s, d):
    return table(s, d, "events").select("event_id", X.chinese_date(F.col("ts")).alias("day"))


@query
def model_base_url(s, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("DeepSeek-chat", "some-claude-mini", "gemini-pro", "Qwen-max", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events").select("event_id", X.base_url_of_model(names).alias("base_url"))


@query
def bool_coerce(s, d):
    return _posts(s, d).select("post_id", X.truthy(F.col("priority").cast("string")).alias("flag"), X.truthy(F.coalesce("author", F.lit("no"))).alias("named"))


@query
def cache_key(s, d):
    return _papers(s, d).select("item_ord", X.cache_key(F.col("arxiv_id"), F.col("title"), F.col("url")).alias("lookup_key"))


@query
def prompt_blocks(s, d):
    b = rank.batches(_papers(s, d), [F.col("item_ord")])
    return b.select("item_ord", "batch_id", X.prompt_block(F.col("pos"), F.col("title"), F.col("authors"), F.col("abstract"), F.col("categories")).alias("block"))


@query
def report_lines(s, d):
    b = recall.numbered(_papers(s, d), [F.col("item_ord")], "n")
    return b.select("item_ord", X.report_line(F.col("n"), F.col("title"), F.col("authors"), F.col("url")).alias("line"))


@query
def report_lines_pdf(s, d):
    b = recall.numbered(_papers(s, d), [F.col("item_ord")], "n")
    mark = X.pdf_mark(F.col("source") == "arxiv", F.col("item_ord") % 5 == 0)
    return b.select("item_ord", X.report_line(F.col("n"), F.col("title"), F.col("authors"), F.col("url"), mark=mark).alias("line"))


@query
def blog_lines(s, d):
    b = recall.numbered(schema.blog_items(_posts(s, d)), [F.col("item_ord")], "n")
    return b.select("item_ord", X.blog_line(F.col("n"), F.col("title"), F.col("blog_source"), F.col("url"), F.col("abstract")).alias("line"))


@query
def event_normalize(s, d):
    return feedback.normalized(_events(s, d)).select("event_id", "label", "status", "reviewer", F.col("resolved_semantic_paper_id").alias("paper_id"), "error")


@query
def run_report(s, d):
    first = _runs(s, d).agg(F.min("run_id").alias("run_id"))
    return _runs(s, d).join(first, "run_id", "left_semi").select("run_id", F.length("report_html").cast("bigint").alias("length"))


@query
def pdf_flags(s, d):
    done = _papers(s, d).where("source = 'arxiv'").select(recall.identity().alias("identity"))
    return report.flagged(_papers(s, d), done).groupBy("source", "has_pdf").agg(n_().alias("n_rows"))


@query
def item_json(s, d):
    kept = F.struct("title", "abstract", "url", "source", "arxiv_id", "semantic_paper_id")
    p = _papers(s, d).withColumn("doc", F.to_json(kept, {"ignoreNullFields": "false"}))
    back = F.from_json("doc", "title string, abstract string, url string, source string, arxiv_id string, semantic_paper_id string")
    return p.withColumn("b", back).select("item_ord", F.col("b.title").alias("title"), F.length("b.abstract").cast("bigint").alias("abstract_length"), F.coalesce("b.source", F.lit("manual")).alias("source"), F.col("b.arxiv_id").alias("arxiv_id"))


@query
def props_json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- memory -----------------------------------------------------------------------------


@query
def memory_keys(s, d):
    p = _papers(s, d)
    return p.select("item_ord", F.explode(memory.item_keys(p)).alias("key"))


@query
def memory_key_union(s, d):
    p = _papers(s, d)
    return p.select(F.explode(memory.item_keys(p)).alias("key")).distinct()


@query
def seen_suppression(s, d):
    kept = memory.suppress(_papers(s, d), memory.live(_memory(s, d), ts(AS_OF), TTL_DAYS))
    return kept.select("item_ord", "source")


@query
def suppression_stats(s, d):
    return memory.suppression_stats(_papers(s, d), memory.live(_memory(s, d), ts(AS_OF), TTL_DAYS))


@query
def memory_ttl_prune(s, d):
    return memory.live(_memory(s, d), ts(AS_OF), TTL_DAYS).select("seen", "seen_at")


@query
def memory_cap(s, d):
    once = memory.upsert(_memory(s, d), _memory(s, d).limit(0), ts(AS_OF))
    return memory.capped(once, CAP)


@query
def memory_upsert(s, d):
    p = _papers(s, d).where("source = 'huggingface'")
    return memory.upsert(_memory(s, d), p.select(F.explode(memory.item_keys(p)).alias("seen")), ts(AS_OF))


@query
def memory_update(s, d):
    return memory.update_from_report(_memory(s, d), _papers(s, d), report.shown_links(_runs(s, d)), ["semantic_scholar", "arxiv", "huggingface"], ts(AS_OF), TTL_DAYS)


# --- reports and manifests ---------------------------------------------------------------


@query
def report_visible(s, d):
    return report.visible(_papers(s, d), report.shown_links(_runs(s, d))).select("item_ord", "href")


@query
def manifest_visible(s, d):
    return report.visible(_papers(s, d), report.shown_links(_runs(s, d)), all_if_none=True).groupBy("source").agg(n_().alias("n_rows"))


@query
def item_numbering(s, d):
    return _manifest(s, d).select("run_id", "item_id", "item_ord", "title", "semantic_paper_id", "feedback_enabled")


@query
def questionnaire(s, d):
    return report.questionnaire(_manifest(s, d))


@query
def manifest_documents(s, d):
    doc = report.manifest_documents(_manifest(s, d))
    parsed = F.from_json("document", "version string, run_id string, papers array<struct<item_id:string,title:string>>")
    return doc.withColumn("p", parsed).select("run_id", F.size("p.papers").cast("bigint").alias("n_papers"), F.col("p.papers")[0]["item_id"].alias("first_item"))


@query
def link_decoration(s, d):
    notes = _manifest(s, d).select(X.normalize_url(F.col("url")).alias("href")).distinct().withColumn("note", F.lit(" [rate]"))
    return report.decorated(_runs(s, d), notes).select("run_id", F.length("report_html").cast("bigint").alias("length"), ((F.length("report_html") - F.length(F.replace("report_html", F.lit(" [rate]")))) / 7).cast("bigint").alias("n_notes"))


@query
def report_header(s, d):
    c = recall.routed(schema.union_sources(schema.blog_items(_posts(s, d)), _papers(s, d))).groupBy("source").agg(F.count_if(~F.col("is_blog")).alias("n_papers"), F.count_if("is_blog").alias("n_blogs"))
    return c.select("source", report.header(F.col("n_papers"), F.col("n_blogs")).alias("header"))


@query
def keyword_footer(s, d):
    return report.keyword_footer(recall.keyword_recall(_papers(s, d), INCLUDE, EXCLUDE))


# --- feedback ------------------------------------------------------------------------------


@query
def label_validation(s, d):
    return _events(s, d).groupBy("label", recall.known_label().alias("known")).agg(n_().alias("n_events"))


@query
def event_resolve(s, d):
    index = feedback.manifest_index(_manifest(s, d), F.col("pos"))
    return feedback.resolve_events(_events(s, d), index).select("event_id", "run_id", "item_id", "paper_id")


@query
def event_manifest_miss(s, d):
    index = feedback.manifest_index(_manifest(s, d), F.col("pos"))
    return feedback.resolve_events(_events(s, d), index, own=None).where("paper_id is null").groupBy("run_id").agg(n_().alias("n_missing"))


@query
def event_winner(s, d):
    good = feedback.resolve_events(_pending(s, d), _index(s, d)).where(recall.known_label().isNotNull())
    return feedback.winners(good, "paper_id", _order()).select("paper_id", "event_id", "label", "created_at")


@query
def event_outcome(s, d):
    index = feedback.manifest_index(_manifest(s, d), F.col("pos"))
    return feedback.outcomes(feedback.resolve_events(_pending(s, d), index), _order()).select("event_id", "paper_id", "outcome", "reason")


@query
def queue_outcome(s, d):
    """As a queue is judged: the manifest alone gives ids."""
    judged = feedback.outcomes(feedback.resolve_events(_pending(s, d), _index(s, d), own=None), _order(), queue=True)
    return judged.select("event_id", "paper_id", "outcome", "reason")


@query
def apply_counts(s, d):
    index = feedback.manifest_index(_manifest(s, d), F.col("pos"))
    return feedback.counters(feedback.outcomes(feedback.resolve_events(_pending(s, d), index), _order()))


@query
def latest_label(s, d):
    return feedback.latest_labels(_events(s, d), ["run_id", "item_id"], _order())


@query
def status_distribution(s, d):
    return _events(s, d).groupBy("status", "source").agg(n_().alias("n_events"))


@query
def recent_events(s, d):
    return _events(s, d).orderBy(F.col("received_at").desc(), F.col("event_id").desc()).limit(20).select("event_id", "received_at", "label")


@query
def pending_events(s, d):
    return _pending(s, d).select("event_id", "run_id", "item_id", F.lower(X.strip(F.col("label"))).alias("label"))


def _seeds(s, d):
    """Standing preferences: papers by source, for the queries on seed sets."""
    ids = _papers(s, d).select(F.nullif(X.normalize_paper_id(F.col("semantic_paper_id")), F.lit("")).alias("paper_id"), "item_ord").where("paper_id is not null")
    return ids.groupBy("paper_id").agg(F.min("item_ord").alias("o")).select("paper_id", F.when(F.col("o") % 2 == 0, "positive").otherwise("negative").alias("polarity"))


@query
def seed_merge(s, d):
    index = feedback.manifest_index(_manifest(s, d), F.col("pos"))
    return feedback.apply_feedback(_pending(s, d), index, _seeds(s, d), _order())[0]


@query
def seed_sizes(s, d):
    return _seeds(s, d).groupBy("polarity").agg(n_().alias("n_ids"))


@query
def seed_sort(s, d):
    n = recall.numbered(_seeds(s, d), feedback.seed_order(), "position")
    return n.select("paper_id", "position")


@query
def label_resolve_cascade(s, d):
    m = _manifest(s, d)
    one = m.groupBy().agg(F.min("run_id").alias("r"))
    m = m.join(F.broadcast(one), F.col("run_id") == F.col("r")).select("item_id", "title", "url", F.coalesce("semantic_paper_id", F.lit("")).alias("semantic_paper_id"), "pos")
    labels = _papers(s, d).select(F.col("item_ord"), F.concat(F.lit("p"), F.lpad((F.col("item_ord") % 97).cast("string"), 2, "0")).alias("item_id"), "semantic_paper_id", "title", "url")
    return feedback.label_cascade(labels, m).select("item_ord", "paper_id", "matched_by")


# --- ranking and resolution ----------------------------------------------------------------


@query
def batch_assign(s, d):
    b = rank.batches(_papers(s, d).select("item_ord"), [F.col("item_ord")])
    return b.select("item_ord", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("pos").cast("bigint").alias("pos"))


def _answers(rows: DataFrame) -> DataFrame:
    """Model answers made up from the rows: a score a row, every seventh quoted, every eleventh left out; of six batches one is no array, and one ends in a number that is none."""
    score = (F.col("item_ord") * 7 % 11).cast("string")
    one = F.concat(F.lit('{"paper_num": '), F.col("pos").cast("string"), F.lit(', "score": '), F.when(F.col("item_ord") % 7 == 0, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score), F.lit(', "reason": "r'), F.col("item_ord").cast("string"), F.lit('"}'))
    kept = rows.withColumn("o", F.when(F.col("item_ord") % 11 != 0, one))
    g = kept.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "o"))).alias("l"))
    last = F.when(F.col("batch_id") % 6 == 2, ', {"paper_num": "x", "score": 1}]').when(F.col("batch_id") % 6 == 1, "").otherwise("]")
    return g.select("batch_id", F.concat(F.lit("```json\n["), F.array_join(F.filter(F.transform("l", lambda x: x["o"]), lambda x: x.isNotNull()), ", "), last, F.lit("\n```")).alias("answer"))


def _scored(s, d):
    b = rank.batches(_papers(s, d).select("item_ord"), [F.col("item_ord")])
    answers = _answers(b)
    return rank.with_fallback(b, rank.parse_scores(answers), answers)


@query
def llm_json_parse(s, d):
    b = rank.batches(_papers(s, d).select("item_ord"), [F.col("item_ord")])
    return rank.parse_scores(_answers(b)).select(F.col("batch_id").cast("bigint").alias("batch_id"), F.col("paper_num").cast("bigint").alias("paper_num"), F.round("score", 4).alias("score"), "reason")


@query
def score_join(s, d):
    return _scored(s, d).select("item_ord", F.round("relevance_score", 4).alias("relevance_score"), "filter_reason")


@query
def topk_rank(s, d):
    return rank.ranked(_scored(s, d), 20).select("item_ord", F.round("relevance_score", 4).alias("relevance_score"))


@query
def default_scorer(s, d):
    p = _papers(s, d).select("item_ord", "title", "abstract")
    return rank.score_with(p, rank.lexical_scorer(sorted(set(INCLUDE)))).select("item_ord", F.round("relevance_score", 4).alias("relevance_score"), "filter_reason")


def _catalogue(s, d):
    year = F.substring("published_date", 1, 4).try_cast("int")
    return _papers(s, d).select(F.col("item_ord").alias("id"), "title", year.alias("year"), F.transform("authors", lambda a: a["name"]).alias("authors"))


@query
def title_match(s, d):
    c = _catalogue(s, d)
    return resolve.title_matches(c, c)


@query
def lookup_budget(s, d):
    keys = _papers(s, d).select(X.cache_key(F.col("arxiv_id"), F.col("title"), F.col("url")).alias("lookup_key")).distinct()
    return resolve.within_budget(keys, 25, [F.col("lookup_key")])


def _resolved(s, d, budget=None):
    p = _papers(s, d)
    known = p.where("nullif(trim(semantic_paper_id), '') is not null and nullif(trim(arxiv_id), '') is not null")
    by_arxiv = known.groupBy(X.normalize_arxiv_id(F.col("arxiv_id")).alias("arxiv_key")).agg(F.min(X.normalize_paper_id(F.col("semantic_paper_id"))).alias("found_id")).withColumn("failed", F.lit(False))
    c = _catalogue(s, d)
    ids = p.select(F.col("item_ord").alias("match_id"), F.nullif(X.normalize_paper_id(F.col("semantic_paper_id")), F.lit("")).alias("found_id")).where("found_id is not null")
    identified = c.join(ids.select(F.col("match_id").alias("id")), "id", "left_semi")
    by_title = resolve.title_matches(c, identified).join(ids, "match_id").select(F.col("id").alias("item_ord"), "found_id")
    return resolve.resolve(p, by_arxiv, by_title, budget)


@query
def resolve_order(s, d):
    return _resolved(s, d).select("item_ord", "paper_id", "status", "method", "error")


@query
def resolver_stats(s, d):
    return resolve.stats(_resolved(s, d, 25))


@query
def author_overlap(s, d):
    names = F.filter(F.transform("authors", lambda a: X.match_title(a["name"])), lambda n: n != "")
    p = _papers(s, d).select("item_ord", names.alias("names"), X.normalize_url(F.col("url")).alias("page")).where("page <> ''")
    w = Window.partitionBy("page").orderBy("item_ord")
    pairs = p.withColumn("before", F.lag("names").over(w)).where("before is not null")
    return pairs.select("item_ord", F.arrays_overlap("names", "before").alias("shared"))


@query
def funnel_counts(s, d):
    return pipeline.funnel(s, d, INCLUDE, EXCLUDE, ts(AS_OF), TTL_DAYS)


# --- extensions ----------------------------------------------------------------------------


@query
def embedding_knn(s, d):
    e = table(s, d, "embeddings")
    return vectors.recommend(e, F.col("label") == 1, F.col("label") == 2, 20).select("vec_id", F.round("score", 6).alias("score"))


@query
def stream_apply(s, d):
    return stream.winners_of_stream(s, d, _index(s, d), F.lit(AS_OF))


@query
def stream_daily(s, d):
    return stream.daily_of_stream(s, d)


@query
def p3_found(s, d):
    return instants.p3_found(s, d)


@query
def p3_kinds(s, d):
    return instants.p3_kinds(s, d)


from sievelark.plans.oracles import ORACLES  # noqa: E402, F401
