"""SQL twins of the core queries, over the same tables. Queries on streams, signed tokens and typed times have none."""

from __future__ import annotations

WS = r"'^\s+|\s+$'"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {WS}, '', 'g')"


def squash(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def norm_url(c: str) -> str:
    pat = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)'"
    part = lambda i: f"regexp_extract({strip(c)}, {pat}, {i})"
    path = f"regexp_replace({part(3)}, '/+$', '')"
    scheme = f"CASE WHEN {part(1)} = '' THEN 'https' ELSE lower({part(1)}) END"
    return f"CASE WHEN {strip(c)} = '' THEN '' WHEN {part(2)} <> '' THEN ({scheme}) || '://' || lower({part(2)}) || {path} WHEN {path} = '' OR starts_with({path}, '/') THEN ({scheme}) || '://' || {path} ELSE ({scheme}) || ':' || {path} END"


def paper_id(c: str) -> str:
    return f"CASE WHEN regexp_full_match({strip(c)}, '[0-9]+') THEN 'CorpusId:' || {strip(c)} ELSE {strip(c)} END"


def arxiv_id(c: str) -> str:
    return f"lower({strip(f'''regexp_replace({strip(c)}, '^arxiv:', '', 'i')''')})"


def match_title(c: str) -> str:
    return squash(f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')")


def html_plain(c: str) -> str:
    return squash(f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')")


INCLUDE = ["retrieval", "alignment", "Reasoning", "calibration", "planning", "alignment"]
EXCLUDE = ["jailbreaks", "watermarks"]
TEXT = "lower(concat_ws(' ', nullif(title, ''), nullif(abstract, '')))"
HITS = "list_filter([" + ", ".join(f"CASE WHEN contains({TEXT}, '{k.lower()}') THEN '{k}' END" for k in INCLUDE) + "], lambda x: x IS NOT NULL)"
KEPT = " AND ".join(f"NOT contains({TEXT}, '{k}')" for k in EXCLUDE)
IDENTITY = "coalesce(nullif(arxiv_id, ''), url)"
UNIQUE = f"SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY {IDENTITY} ORDER BY item_ord) = 1"
AS_OF, TTL, CAP = "TIMESTAMP '2025-06-30 00:00:00'", 120, 500
LIVE = f"SELECT seen, seen_at FROM semantic_scholar_memory WHERE {strip('seen')} <> '' AND seen_at >= {AS_OF} - INTERVAL {TTL} DAY"
KEYS = f"""SELECT item_ord, source, unnest(list_distinct(list_filter([
  CASE WHEN {arxiv_id("arxiv_id")} <> '' THEN 'arxiv:' || {arxiv_id("arxiv_id")} END,
  CASE WHEN {paper_id("semantic_paper_id")} <> '' THEN 'semantic:' || ({paper_id("semantic_paper_id")}) END,
  CASE WHEN {paper_id("semantic_paper_id")} <> '' THEN {paper_id("semantic_paper_id")} END,
  CASE WHEN source = 'huggingface' AND {arxiv_id("arxiv_id")} = '' AND {norm_url("url")} <> '' THEN 'hf:' || ({norm_url("url")}) END,
  CASE WHEN source = 'arxiv' AND {arxiv_id("arxiv_id")} = '' AND {norm_url("url")} <> '' THEN 'arxiv:' || ({norm_url("url")}) END], lambda x: x IS NOT NULL))) AS key FROM papers"""
EVENTS = "SELECT * FROM feedback_events QUALIFY row_number() OVER (PARTITION BY event_id) = 1"
BLOGS = """SELECT post_id AS item_ord, '[Blog] ' || coalesce(title, '') AS title, left(coalesce(content, ''), 2000) AS abstract, url, 'manual' AS source, source_name AS blog_source,
  'From: ' || source_name AS notes, priority AS skip_filter, CASE WHEN trim(coalesce(author, '')) <> '' THEN 1 ELSE 0 END AS n_authors FROM blog_posts"""
LINKS = f"""SELECT run_id, unnest(range(len(u))) AS pos, unnest(u) AS href FROM (SELECT run_id, list_filter(list_transform(regexp_extract_all(coalesce(report_html, ''), '(?i)href=["'']([^"'']+)["'']', 1), lambda x: {norm_url("x")}), lambda x: x <> '') AS u FROM feedback_runs)"""
MANIFEST = f"""SELECT run_id, 'p' || CASE WHEN pos < 10 THEN '0' || pos ELSE pos::VARCHAR END AS item_id, item_ord, nullif({strip("title")}, '') AS title, nullif({strip("url")}, '') AS url,
  nullif({paper_id("semantic_paper_id")}, '') AS semantic_paper_id, ({paper_id("semantic_paper_id")}) <> '' AS feedback_enabled, pos FROM (
  SELECT f.run_id, row_number() OVER (PARTITION BY f.run_id ORDER BY f.at) AS pos, o.* FROM (SELECT run_id, href, min(pos) AS at FROM links GROUP BY ALL) f
  JOIN (SELECT *, {norm_url("url")} AS href FROM papers QUALIFY row_number() OVER (PARTITION BY {norm_url("url")} ORDER BY item_ord) = 1) o ON o.href = f.href)"""
BASE_CTE = f"links AS ({LINKS}), manifest AS ({MANIFEST}), events_once AS ({EVENTS})"
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"
WHEN = f"coalesce(CASE WHEN regexp_matches({strip('created_at')}, '{ISO}') THEN epoch_us(try_cast({strip('created_at')} AS TIMESTAMPTZ)) END, epoch_us({AS_OF}))"
PENDING = f"lower({strip('status')}) = 'pending'"
RESOLVED = f"""{BASE_CTE}, resolved AS (SELECT e.*, coalesce(nullif({paper_id("e.resolved_semantic_paper_id")}, ''), m.semantic_paper_id) AS paper_id FROM events_once e LEFT JOIN manifest m ON e.run_id = m.run_id AND e.item_id = m.item_id),
judged AS (SELECT *, {WHEN} AS made_at, lower(trim(label)) IN ('positive', 'negative', 'undecided') AS good FROM resolved WHERE {PENDING}),
outcome AS (SELECT *, CASE WHEN NOT good THEN 'invalid label' WHEN paper_id IS NULL THEN 'no semantic_paper_id mapping' WHEN row_number() OVER (PARTITION BY paper_id, good AND paper_id IS NOT NULL ORDER BY made_at DESC, event_id DESC) > 1 THEN 'superseded by newer event' END AS reason FROM judged)"""
SEEDS = f"""SELECT paper_id, CASE WHEN min(item_ord) % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity FROM (SELECT nullif({paper_id("semantic_paper_id")}, '') AS paper_id, item_ord FROM papers) WHERE paper_id IS NOT NULL GROUP BY 1"""
BATCH = "SELECT item_ord, (row_number() OVER (ORDER BY item_ord) - 1) // 10 AS batch_id, (row_number() OVER (ORDER BY item_ord) - 1) % 10 + 1 AS pos, * EXCLUDE (item_ord) FROM papers"
SCORED = f"SELECT item_ord, batch_id, pos AS paper_num, round((item_ord * 7 % 11) / 10.0, 4) AS score, 'r' || item_ord AS reason FROM ({BATCH}) WHERE item_ord % 11 <> 0"
FALLBACK = f"""SELECT b.item_ord, coalesce(CASE WHEN b.batch_id % 6 <> 1 THEN s.score END, 0.0)::DOUBLE AS relevance_score, coalesce(CASE WHEN b.batch_id % 6 <> 1 THEN s.reason END, '') AS filter_reason
 FROM ({BATCH}) b LEFT JOIN ({SCORED}) s ON s.item_ord = b.item_ord WHERE b.batch_id % 6 IN (1, 2) OR s.item_ord IS NOT NULL"""
YEAR = "try_cast(substr(published_date, 1, 4) AS INTEGER)"
NAMES = f"list_filter(list_transform(authors, lambda a: {match_title('a.name')}), lambda n: n <> '')"
TITLES = f"""SELECT a.item_ord AS id, b.item_ord AS match_id FROM papers a JOIN papers b ON {match_title("a.title")} = {match_title("b.title")} AND {match_title("a.title")} <> '' AND a.item_ord <> b.item_ord
 WHERE coalesce(abs({YEAR.replace("published_date", "a.published_date")} - {YEAR.replace("published_date", "b.published_date")}) <= 1, false) OR coalesce(list_has_any({NAMES.replace("authors", "a.authors")}, {NAMES.replace("authors", "b.authors")}), false)"""
LOOKUP = f"CASE WHEN {arxiv_id('arxiv_id')} <> '' THEN 'arxiv:' || {arxiv_id('arxiv_id')} ELSE 'title:' || {match_title('title')} || '|url:' || lower({strip('url')}) END"


def resolved_sql(budget: bool) -> str:
    over = "looked AND NOT coalesce(in_budget, false)" if budget else "false"
    return f"""WITH titles AS ({TITLES}), p AS (SELECT item_ord, nullif({paper_id("semantic_paper_id")}, '') AS own, nullif({arxiv_id("arxiv_id")}, '') AS a, {LOOKUP} AS lookup_key, nullif({paper_id("semantic_paper_id")}, '') IS NULL AND coalesce(lower(trim(source)) IN ('arxiv', 'huggingface'), false) AS looked FROM papers),
fa AS (SELECT {arxiv_id("arxiv_id")} AS a, min({paper_id("semantic_paper_id")}) AS found FROM papers WHERE nullif(trim(semantic_paper_id), '') IS NOT NULL AND nullif(trim(arxiv_id), '') IS NOT NULL GROUP BY 1),
ft AS (SELECT t.id AS item_ord, arg_min(q.own, q.item_ord) AS found FROM titles t JOIN p q ON q.item_ord = t.match_id WHERE q.own IS NOT NULL GROUP BY 1),
w AS (SELECT lookup_key, min(item_ord) AS first_ord FROM p WHERE looked GROUP BY 1), b AS (SELECT lookup_key, true AS in_budget FROM w ORDER BY first_ord LIMIT 25),
r AS (SELECT p.item_ord, own, looked, p.item_ord = w.first_ord AS is_first, fa.found AS fa, ft.found AS ft, {over} AS over_it FROM p LEFT JOIN fa ON fa.a = p.a LEFT JOIN ft ON ft.item_ord = p.item_ord LEFT JOIN b ON b.lookup_key = p.lookup_key LEFT JOIN w ON w.lookup_key = p.lookup_key),
s AS (SELECT item_ord, looked, is_first, over_it, CASE WHEN over_it THEN 'budget_exhausted' END AS error, CASE WHEN own IS NOT NULL THEN 'existing' WHEN NOT looked THEN 'unresolved' WHEN over_it THEN 'error' WHEN coalesce(fa, ft) IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
 CASE WHEN own IS NOT NULL THEN 'existing' WHEN over_it OR NOT looked THEN 'none' WHEN fa IS NOT NULL THEN 'arxiv' WHEN ft IS NOT NULL THEN 'title_search' ELSE 'none' END AS method, own, fa, ft FROM r)
SELECT """


def sentence(c: str) -> str:
    s = f"array_to_string(string_split({c}, '. ')[1:3], '. ')"
    return f"CASE WHEN ends_with({s}, '.') THEN {s} ELSE {s} || '.' END"


def names_line(affiliations: bool) -> str:
    one = "a.name || CASE WHEN coalesce(a.affiliation, '') <> '' THEN ' (' || a.affiliation || ')' ELSE '' END" if affiliations else "a.name"
    return f"array_to_string(list_transform(authors[1:5], lambda a: {one}), ', ') || CASE WHEN len(authors) > 5 THEN ' et al.' ELSE '' END"


NOTE = """CASE WHEN site = 0 AND content <> '' THEN CASE WHEN regexp_extract(content, '(?i)(\\d+[\\d,]*)\\s*stars?', 1) <> '' THEN 'GitHub repo with ' || regexp_extract(content, '(?i)(\\d+[\\d,]*)\\s*stars?', 1) || ' stars' ELSE 'GitHub implementation available' END
 WHEN site IN (1, 2) THEN CASE WHEN trim(left(content, 100)) <> '' THEN CASE WHEN site = 1 THEN 'Reddit' ELSE 'Twitter' END || ' discussion: ' || regexp_replace(left(content, 100), '^\\s+|\\s+$', '', 'g') || '...' END
 WHEN site = 3 THEN 'HuggingFace: ' || left(coalesce(title, ''), 60) END"""
DIGEST = f"""WITH keys AS ({KEYS}), live AS ({LIVE}), held AS (SELECT DISTINCT item_ord FROM keys WHERE source <> 'manual' AND key IN (SELECT seen FROM live)),
new_items AS (SELECT * FROM papers WHERE item_ord NOT IN (SELECT item_ord FROM held)), uniq AS (SELECT * FROM new_items QUALIFY row_number() OVER (PARTITION BY {IDENTITY} ORDER BY item_ord) = 1),
rec AS (SELECT * FROM uniq WHERE {KEPT} AND len({HITS}) > 0)"""



def token_sql(secret: str) -> str:
    """Signed links as SQL: HMAC-SHA256 written out with the padded keys as constants."""
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(k ^ b for k in key).hex() for b in (0x36, 0x5C))
    b64 = lambda x: f"rtrim(translate(to_base64({x}), '+/', '-_'), '=')"
    json = """'{"exp":"2025-12-31T00:00:00Z","item_id":"' || item_id || '","label":"' || label || '","reviewer":"","run_id":"' || run_id || '","semantic_paper_id":"' || semantic_paper_id || '","v":1}'"""
    return f"""WITH {BASE_CTE}, l AS (SELECT *, unnest(['positive', 'negative', 'undecided']) AS label FROM manifest WHERE feedback_enabled), p AS (SELECT *, {b64(f"encode({json})")} AS payload FROM l),
 t AS (SELECT *, payload || '.' || {b64(f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(payload)))))")} AS token FROM p)
 SELECT run_id, item_id, label, token, 'https://feedback.example/feedback?t=' || token AS link FROM t"""


EMBEDDING = """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
 q AS (SELECT i, coalesce(avg(x) FILTER (label = 1), 0) - coalesce(avg(x) FILTER (label = 2), 0) AS q FROM v GROUP BY i),
 s AS (SELECT vec_id, sum(x * q) / (sqrt(sum(x * x)) * sqrt(sum(q * q))) AS score FROM v JOIN q ON q.i = v.i WHERE label NOT IN (1, 2) GROUP BY 1)
 SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20"""
ORACLES: dict[str, str] = {
    "feedback_token": token_sql("not a secret"),
    "flagship_recall_rank": f"SELECT item_ord, title, array_to_string({HITS}, ',') AS keywords, len({HITS})::BIGINT AS n FROM ({UNIQUE}) WHERE {KEPT} AND len({HITS}) > 0 ORDER BY n DESC, item_ord LIMIT 20",
    "keyword_recall": f"SELECT item_ord, array_to_string({HITS}, ',') AS keywords FROM papers WHERE len({HITS}) > 0",
    "keyword_exclude": f"SELECT item_ord, 0::BIGINT AS n FROM papers WHERE {KEPT}",
    "recency_filter": "SELECT item_ord, fetched_at FROM papers WHERE fetched_at >= TIMESTAMP '2025-02-01 00:00:00'",
    "recency_undated_kept": "SELECT doc_id, collected_at FROM documents WHERE collected_at IS NULL OR collected_at >= TIMESTAMP '2025-02-01 00:00:00'",
    "dedup_first_wins": f"SELECT item_ord, arxiv_id, url, source FROM ({UNIQUE})",
    "blog_dedup": "SELECT post_id, url, feed_key FROM blog_posts QUALIFY row_number() OVER (PARTITION BY url ORDER BY post_id) = 1",
    "union_sources": f"SELECT 0::BIGINT AS rank, item_ord, title, source, true AS is_blog, blog_source, notes FROM ({BLOGS}) UNION ALL SELECT 1, item_ord, title, source, false, NULL, NULL FROM papers",
    "blog_to_item": f"SELECT item_ord, title, abstract, source, notes, skip_filter, n_authors::BIGINT AS n_authors FROM ({BLOGS})",
    "source_routing": "SELECT 'blog' AS route, 'manual' AS source, count(*) AS n_rows FROM blog_posts UNION ALL SELECT 'filtered', source, count(*) FROM papers GROUP BY source",
    "eligible_by_source": "SELECT source, count(*) AS n_rows FROM papers WHERE source IN ('semantic_scholar', 'arxiv', 'huggingface') GROUP BY 1",
    "first_posts_per_feed": "SELECT feed_key, rn, post_id FROM (SELECT *, row_number() OVER (PARTITION BY feed_key ORDER BY fetched_at DESC, post_id) AS rn FROM blog_posts) WHERE rn <= 5 AND (fetched_at IS NULL OR fetched_at >= TIMESTAMP '2025-03-01 00:00:00')",
    "threshold_gate": "SELECT item_ord, source FROM papers QUALIFY row_number() OVER (ORDER BY item_ord) <= CASE WHEN (SELECT count(*) FROM papers) <= 50 THEN 50 ELSE 20 END",
    "head_without_sort": "SELECT item_ord, title FROM papers ORDER BY item_ord LIMIT 15",
    "enabled_feeds": "SELECT feed_key, count(*) AS n_posts FROM blog_posts WHERE feed_key IN (SELECT feed_key FROM blog_feeds WHERE priority) GROUP BY 1",
    "priority_counts": "SELECT count(*) FILTER (priority) AS n_priority, count(*) FILTER (NOT priority) AS n_normal FROM blog_posts",
    "url_normalize": f"SELECT DISTINCT url, {norm_url('url')} AS norm FROM (SELECT url FROM papers UNION ALL SELECT url FROM blog_posts)",
    "id_normalize": f"SELECT item_ord, {paper_id('semantic_paper_id')} AS paper_id, {arxiv_id('arxiv_id')} AS arxiv_key FROM papers",
    "arxiv_id_from_url": r"SELECT item_ord, regexp_extract(coalesce(url, ''), '/(?:abs|pdf)/(\d+\.\d+)', 1) AS found FROM papers",
    "title_normalize": f"SELECT item_ord, {squash('lower(title)')} AS spaced, {match_title('title')} AS matched FROM papers",
    "href_extract": f"SELECT run_id, pos::BIGINT AS pos, href FROM ({LINKS})",
    "html_strip": f"SELECT post_id, {html_plain('content')} AS plain FROM blog_posts",
    "truncate_marker": f"SELECT post_id, CASE WHEN length(t) > 300 THEN left(t, 300) || '... [Truncated for token efficiency]' ELSE t END AS short FROM (SELECT post_id, {html_plain('content')} AS t FROM blog_posts)",
    "three_sentences": f"SELECT item_ord, {sentence('abstract')} AS summary FROM papers WHERE abstract IS NOT NULL",
    "search_query": "SELECT item_ord, '\"' || title || '\" (site:github.com OR site:reddit.com OR site:twitter.com OR site:huggingface.co) (review OR discussion OR implementation OR reproducibility)' AS q FROM papers",
    "signal_extract": f"""SELECT item_ord, coalesce(nullif(array_to_string(list_filter([{NOTE}, CASE WHEN item_ord % 2 = 0 THEN 'HuggingFace: card' END], lambda x: x IS NOT NULL), '. ') || '.', '.'), 'No significant external signals found.') AS research_notes
 FROM (SELECT item_ord, title, item_ord % 5 AS site, CASE WHEN item_ord % 3 = 0 THEN (item_ord * 1000) || ' stars' ELSE coalesce(abstract, '') END AS content FROM papers)""",
    "b64url": "SELECT item_ord, rtrim(translate(to_base64(encode(title)), '+/', '-_'), '=') AS coded, title AS back FROM papers",
    "run_view_url": f"SELECT run_id, 'https://feedback.example/run?run_id=' || url_encode({strip('run_id')}) AS view_url FROM feedback_runs",
    "run_id_format": "SELECT item_ord, strftime(fetched_at, '%Y-%m-%dT%H-%M-%SZ') AS run, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(fetched_at, '%f') = '000000' THEN '' ELSE '.' || strftime(fetched_at, '%f') END || 'Z' AS iso FROM papers",
    "chinese_date": "SELECT event_id, strftime(ts, '%Y年%m月%d日') || ' ' || ['周一', '周二', '周三', '周四', '周五', '周六', '周日'][isodow(ts)] AS day FROM events",
    "model_base_url": "SELECT event_id, ['https://api.deepseek.com/v1', 'https://api.anthropic.com/v1', 'https://generativelanguage.googleapis.com/v1beta/openai', 'https://dashscope.aliyuncs.com/compatible-mode/v1', NULL][event_id % 5 + 1] AS base_url FROM events",
    "bool_coerce": "SELECT post_id, lower(priority::VARCHAR) NOT IN ('false', '0', 'no', 'off') AS flag, lower(coalesce(author, 'no')) NOT IN ('false', '0', 'no', 'off') AS named FROM blog_posts",
    "cache_key": f"SELECT item_ord, {LOOKUP} AS lookup_key FROM papers",
    "prompt_blocks": f"""SELECT item_ord, batch_id, chr(10) || 'Paper ' || pos || ':' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Authors: ' || {names_line(True)} || chr(10) || 'Abstract: ' || left(coalesce(abstract, ''), 600) || '...' || chr(10) || 'Categories: ' ||
 CASE WHEN len(categories) > 0 THEN array_to_string(categories[1:3], ', ') ELSE 'N/A' END AS block FROM ({BATCH})""",
    "report_lines": f"SELECT item_ord, row_number() OVER (ORDER BY item_ord) || '. ' || coalesce(title, '') || chr(10) || '   Authors: ' || {names_line(False)} || chr(10) || '   URL: ' || coalesce(url, '') AS line FROM papers",
    "report_lines_pdf": f"SELECT item_ord, row_number() OVER (ORDER BY item_ord) || '. ' || coalesce(title, '') || CASE WHEN item_ord % 5 = 0 THEN ' [⚠️ PDF失败]' WHEN source = 'arxiv' THEN ' [📄 PDF]' ELSE '' END || chr(10) || '   Authors: ' || {names_line(False)} || chr(10) || '   URL: ' || coalesce(url, '') AS line FROM papers",
    "blog_lines": "SELECT post_id AS item_ord, row_number() OVER (ORDER BY post_id) || '. ' || coalesce(title, '') || chr(10) || '   Source: ' || coalesce(source_name, 'Unknown') || chr(10) || '   URL: ' || coalesce(url, '') || chr(10) || '   Content: ' || CASE WHEN coalesce(content, '') = '' THEN 'No content preview' ELSE left(content, 500) END || '...' AS line FROM blog_posts",
    "event_normalize": f"SELECT event_id, lower({strip('label')}) AS label, coalesce(nullif(lower({strip('status')}), ''), 'pending') AS status, {strip('reviewer')} AS reviewer, {paper_id('resolved_semantic_paper_id')} AS paper_id, {strip('error')} AS error FROM ({EVENTS})",
    "run_report": "SELECT run_id, length(report_html)::BIGINT AS length FROM feedback_runs WHERE run_id = (SELECT min(run_id) FROM feedback_runs)",
    "pdf_flags": f"SELECT source, {IDENTITY} IN (SELECT {IDENTITY} FROM papers WHERE source = 'arxiv') AS has_pdf, count(*) AS n_rows FROM papers GROUP BY 1, 2",
    "item_json": "SELECT item_ord, title, length(abstract)::BIGINT AS abstract_length, coalesce(source, 'manual') AS source, arxiv_id FROM papers",
    "props_json": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "memory_keys": f"SELECT item_ord, key FROM ({KEYS})",
    "memory_key_union": f"SELECT DISTINCT key FROM ({KEYS})",
    "seen_suppression": f"WITH live AS ({LIVE}) SELECT item_ord, source FROM papers WHERE item_ord NOT IN (SELECT item_ord FROM ({KEYS}) WHERE key IN (SELECT seen FROM live))",
    "suppression_stats": f"WITH live AS ({LIVE}), held AS (SELECT DISTINCT item_ord FROM ({KEYS}) WHERE key IN (SELECT seen FROM live)) SELECT count(*) AS total, count(h.item_ord) AS suppressed, count(*) - count(h.item_ord) AS forwarded FROM papers p LEFT JOIN held h ON h.item_ord = p.item_ord",
    "memory_ttl_prune": LIVE,
    "memory_cap": f"SELECT seen, max(seen_at) AS seen_at FROM semantic_scholar_memory GROUP BY 1 ORDER BY seen_at DESC NULLS LAST, seen LIMIT {CAP}",
    "memory_upsert": f"SELECT seen, max(seen_at) AS seen_at FROM (SELECT seen, seen_at FROM semantic_scholar_memory UNION ALL SELECT key, {AS_OF} FROM ({KEYS}) WHERE source = 'huggingface') GROUP BY 1",
    "memory_update": f"""WITH links AS ({LINKS}), shown AS (SELECT item_ord FROM papers WHERE source IN ('semantic_scholar', 'arxiv', 'huggingface') AND {norm_url("url")} IN (SELECT href FROM links)),
 m AS (SELECT seen, max(seen_at) AS seen_at FROM (SELECT seen, seen_at FROM semantic_scholar_memory UNION ALL SELECT key, {AS_OF} FROM ({KEYS}) WHERE item_ord IN (SELECT item_ord FROM shown)) GROUP BY 1)
 SELECT seen, seen_at FROM m WHERE {strip("seen")} <> '' AND seen_at >= {AS_OF} - INTERVAL {TTL} DAY""",
    "report_visible": f"WITH links AS ({LINKS}) SELECT item_ord, {norm_url('url')} AS href FROM papers WHERE {norm_url('url')} IN (SELECT href FROM links)",
    "manifest_visible": f"WITH links AS ({LINKS}) SELECT source, count(*) AS n_rows FROM papers WHERE (SELECT count(*) FROM links) = 0 OR {norm_url('url')} IN (SELECT href FROM links) GROUP BY 1",
    "item_numbering": f"WITH {BASE_CTE} SELECT run_id, item_id, item_ord, title, semantic_paper_id, feedback_enabled FROM manifest",
    "questionnaire": f"WITH {BASE_CTE} SELECT run_id, item_id, 'undecided' AS label, '' AS note FROM manifest WHERE feedback_enabled",
    "manifest_documents": f"WITH {BASE_CTE} SELECT run_id, count(*) AS n_papers, min_by(item_id, pos) AS first_item FROM manifest GROUP BY 1",
    "link_decoration": f"""WITH {BASE_CTE}, urls AS (SELECT DISTINCT {norm_url("url")} AS href FROM manifest), hit AS (SELECT run_id, count(*) AS n FROM links WHERE href IN (SELECT href FROM urls) GROUP BY 1)
 SELECT r.run_id, (length(report_html) + 7 * coalesce(n, 0))::BIGINT AS length, coalesce(n, 0)::BIGINT AS n_notes FROM (SELECT run_id, regexp_replace(report_html, '</a\\s*>', '</a>', 'gi') AS report_html FROM feedback_runs) r LEFT JOIN hit h ON h.run_id = r.run_id""",
    "report_header": """WITH c AS (SELECT source, sum(p) AS p, sum(b) AS b FROM (SELECT source, 1 AS p, 0 AS b FROM papers UNION ALL SELECT 'manual', 0, 1 FROM blog_posts) GROUP BY 1)
 SELECT source, CASE WHEN b > 0 AND p > 0 THEN p || ' papers + ' || b || ' blogs reviewed' WHEN b > 0 THEN b || ' blogs reviewed' ELSE p || ' papers reviewed' END AS header FROM c""",
    "keyword_footer": f"SELECT coalesce(nullif(array_to_string(list_sort(list(w)), ', '), ''), 'AI Research') AS footer FROM (SELECT DISTINCT unnest({HITS}) AS w FROM papers WHERE {KEPT} ORDER BY w LIMIT 8)",
    "label_validation": f"SELECT label, CASE WHEN lower(trim(label)) IN ('positive', 'negative', 'undecided') THEN lower(trim(label)) END AS known, count(*) AS n_events FROM ({EVENTS}) GROUP BY 1, 2",
    "event_resolve": f"WITH {RESOLVED} SELECT event_id, run_id, item_id, paper_id FROM resolved",
    "event_manifest_miss": f"WITH {BASE_CTE} SELECT e.run_id, count(*) AS n_missing FROM events_once e LEFT JOIN manifest m ON e.run_id = m.run_id AND e.item_id = m.item_id WHERE m.semantic_paper_id IS NULL GROUP BY 1",
    "event_winner": f"WITH {RESOLVED} SELECT paper_id, event_id, label, created_at FROM outcome WHERE reason IS NULL",
    "queue_outcome": f"""WITH {BASE_CTE}, j AS (SELECT e.*, m.semantic_paper_id AS paper_id, m.item_id IS NOT NULL AS known, lower(trim(label)) IN ('positive', 'negative', 'undecided') AS good, {WHEN} AS made_at FROM events_once e LEFT JOIN manifest m ON e.run_id = m.run_id AND e.item_id = m.item_id WHERE {PENDING}),
 o AS (SELECT *, CASE WHEN NOT good THEN 'invalid label' WHEN NOT known THEN 'item_id not found in manifest' WHEN paper_id IS NULL THEN 'no semantic_paper_id' WHEN row_number() OVER (PARTITION BY paper_id, good ORDER BY made_at DESC, event_id DESC) > 1 THEN 'superseded by newer event' END AS reason FROM j)
 SELECT event_id, paper_id, CASE WHEN reason IS NULL THEN 'applied' ELSE 'rejected' END AS outcome, reason FROM o""",
    "event_outcome": f"WITH {RESOLVED} SELECT event_id, paper_id, CASE WHEN reason IS NULL THEN 'applied' ELSE 'rejected' END AS outcome, reason FROM outcome",
    "apply_counts": f"WITH {RESOLVED} SELECT count(*) FILTER (reason IS NULL) AS applied, count(reason) AS rejected, count(*) FILTER (reason = 'invalid label') AS invalid, count(*) FILTER (reason = 'no semantic_paper_id mapping') AS skipped FROM outcome",
    "latest_label": f"SELECT run_id, item_id, arg_max(label, (made_at, event_id)) AS label FROM (SELECT *, {WHEN} AS made_at FROM ({EVENTS})) GROUP BY 1, 2",
    "status_distribution": f"SELECT status, source, count(*) AS n_events FROM ({EVENTS}) GROUP BY 1, 2",
    "recent_events": f"SELECT event_id, received_at, label FROM ({EVENTS}) ORDER BY received_at DESC, event_id DESC LIMIT 20",
    "pending_events": f"SELECT event_id, run_id, item_id, lower(trim(label)) AS label FROM ({EVENTS}) WHERE {PENDING}",
    "seed_merge": f"""WITH {RESOLVED}, seeds AS ({SEEDS}), d AS (SELECT paper_id, lower(trim(label)) AS l FROM outcome WHERE reason IS NULL)
 SELECT * FROM (SELECT coalesce(s.paper_id, d.paper_id) AS paper_id, coalesce(l, polarity) AS polarity FROM seeds s FULL JOIN d ON s.paper_id = d.paper_id) WHERE polarity IN ('positive', 'negative')""",
    "seed_sizes": f"SELECT polarity, count(*) AS n_ids FROM ({SEEDS}) GROUP BY 1",
    "seed_sort": f"SELECT paper_id, row_number() OVER (ORDER BY d = '', CASE WHEN d <> '' THEN lpad(d, 20, '0') ELSE lower(paper_id) END, paper_id) AS position FROM (SELECT paper_id, regexp_extract(paper_id, '^CorpusId:([0-9]+)$', 1) AS d FROM ({SEEDS}))",
    "label_resolve_cascade": f"""WITH {BASE_CTE}, m AS (SELECT item_id, coalesce(semantic_paper_id, '') AS sp, pos, {squash("lower(title)")} AS t, {norm_url("url")} AS u FROM manifest WHERE run_id = (SELECT min(run_id) FROM manifest)),
 l AS (SELECT item_ord, 'p' || lpad((item_ord % 97)::VARCHAR, 2, '0') AS item_id, {paper_id("semantic_paper_id")} AS sp, {squash("lower(title)")} AS t, {norm_url("url")} AS u FROM papers),
 a AS (SELECT item_id, max_by(sp, pos) AS v FROM m GROUP BY 1), b AS (SELECT DISTINCT sp AS v FROM m WHERE sp <> ''), c AS (SELECT t, u, max_by(sp, pos) AS v FROM m GROUP BY 1, 2)
 SELECT item_ord, coalesce(a.v, b.v, c.v) AS paper_id, CASE WHEN a.v IS NOT NULL THEN 'item_id' WHEN b.v IS NOT NULL THEN 'paper_id' WHEN c.v IS NOT NULL THEN 'title_url' END AS matched_by
 FROM l LEFT JOIN a ON a.item_id = l.item_id LEFT JOIN b ON b.v = l.sp LEFT JOIN c ON c.t = l.t AND c.u = l.u""",
    "batch_assign": f"SELECT item_ord, batch_id::BIGINT AS batch_id, pos::BIGINT AS pos FROM ({BATCH})",
    "llm_json_parse": f"SELECT batch_id::BIGINT AS batch_id, paper_num::BIGINT AS paper_num, score::DOUBLE AS score, reason FROM ({SCORED}) WHERE batch_id % 6 <> 1",
    "score_join": f"SELECT item_ord, relevance_score, filter_reason FROM ({FALLBACK})",
    "topk_rank": f"SELECT item_ord, relevance_score FROM ({FALLBACK}) ORDER BY relevance_score DESC, item_ord LIMIT 20",
    "default_scorer": "SELECT item_ord, round(n / 10.0, 4)::DOUBLE AS relevance_score, n || ' keywords' AS filter_reason FROM (SELECT item_ord, "
    + " + ".join(f"contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '{k.lower()}')::INT" for k in sorted(set(INCLUDE)))
    + " AS n FROM papers)",
    "title_match": f"SELECT id, min(match_id) AS match_id FROM ({TITLES}) GROUP BY 1",
    "lookup_budget": f"SELECT lookup_key, row_number() OVER (ORDER BY lookup_key) <= 25 AS in_budget FROM (SELECT DISTINCT {LOOKUP} AS lookup_key FROM papers)",
    "resolve_order": resolved_sql(False) + "item_ord, CASE status WHEN 'existing' THEN own WHEN 'resolved' THEN coalesce(fa, ft) END AS paper_id, status, method, error FROM s",
    "resolver_stats": resolved_sql(True) + """count(*) FILTER (status IN ('existing', 'resolved')) AS resolved, count(*) FILTER (status = 'unresolved' OR (over_it AND is_first)) AS unresolved, count(*) FILTER (status = 'error' AND NOT (over_it AND is_first)) AS errors,
 count(*) FILTER (looked AND NOT is_first) AS cache_hits, count(*) FILTER (looked AND is_first AND NOT over_it) AS lookups, count(*) FILTER (looked AND is_first AND over_it) AS budget_skips FROM s""",
    "author_overlap": f"SELECT item_ord, list_has_any(n, b) AS shared FROM (SELECT item_ord, {NAMES} AS n, lag({NAMES}) OVER (PARTITION BY {norm_url('url')} ORDER BY item_ord) AS b FROM papers WHERE {norm_url('url')} <> '') WHERE b IS NOT NULL",
    "funnel_counts": DIGEST + " SELECT 'fetched' AS stage, count(*) AS n_rows FROM papers UNION ALL SELECT 'new', count(*) FROM new_items UNION ALL SELECT 'unique', count(*) FROM uniq UNION ALL SELECT 'recalled', count(*) FROM rec UNION ALL SELECT 'ranked', least(20, count(*)) FROM rec",
    "stream_apply": f"WITH {RESOLVED} SELECT paper_id, event_id, label FROM outcome WHERE reason IS NULL",
    "stream_daily": f"SELECT (date_trunc('day', received_at))::TIMESTAMP AS starts, label, count(*) AS n_events FROM ({EVENTS}) GROUP BY 1, 2",
    "token_verify": "WITH " + token_sql("not a secret").split("WITH ", 1)[1].rsplit(" SELECT ", 1)[0] + """ SELECT CASE WHEN label = 'negative' THEN 'invalid token signature' END AS error, CASE WHEN label <> 'negative' THEN label END AS label, count(*) AS n_tokens FROM t GROUP BY 1, 2""",
    "embedding_knn": EMBEDDING,
}
