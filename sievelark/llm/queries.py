"""Registry of the training-data queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from sievelark.llm import history, lookalikes, markup, mixing, names, neardup, packing, seen, truncation

QUERIES = {
    "p1_found": names.p1_found,
    "p1_entities": names.p1_entities,
    "p2_found": neardup.p2_found,
    "p2_groups": neardup.p2_groups,
    "p4_found": truncation.p4_found,
    "p4_rates": truncation.p4_rates,
    "p5_found": history.p5_found,
    "p5_coverage": history.p5_coverage,
    "p6_found": markup.p6_found,
    "p6_clean": markup.p6_clean,
    "p7_found": seen.p7_found,
    "p7_rates": seen.p7_rates,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p9_mixture": mixing.p9_mixture,
    "p9_shares": mixing.p9_shares,
    "p10_found": lookalikes.p10_found,
    "p10_forms": lookalikes.p10_forms,
}
_KEY = r"nullif(regexp_replace(regexp_replace(lower(trim({})), '^((semantic|arxiv|corpusid|s2|doi)\s*:\s*)+', ''), '^(\d{{4}}\.\d{{4,5}})v\d+$', '\1'), '')"

ORACLES: dict[str, str] = {
    "p2_found": r"""WITH t AS (SELECT item_ord, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{L}\p{N}]+') AS w FROM papers),
s AS (SELECT DISTINCT item_ord, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT item_ord, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.item_ord AS x, b.item_ord AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.item_ord < b.item_ord GROUP BY 1, 2)
SELECT x AS item_ord_a, y AS item_ord_b FROM c JOIN n p ON p.item_ord = x JOIN n q ON q.item_ord = y WHERE shared >= 0.5 * (p.n + q.n - shared)""",
    "p7_found": f"""WITH memory AS (SELECT {_KEY.format("seen")} AS key, min(seen_at) AS first_at FROM semantic_scholar_memory GROUP BY 1),
asked AS (SELECT item_ord, fetched_at, {_KEY.format("arxiv_id")} AS key FROM papers UNION ALL SELECT item_ord, fetched_at, {_KEY.format("semantic_paper_id")} AS key FROM papers)
SELECT DISTINCT item_ord FROM asked JOIN memory USING (key) WHERE first_at < fetched_at""",
}
