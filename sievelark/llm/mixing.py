"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. The tokens of each source are summed by hash bucket; the bucket in
which a budget is reached is split into finer buckets, again and again, until it holds one
document: the hash at which the budget is reached, without sorting. Documents below it are taken.
As all budgets use the same hash, a smaller mixture is part of a larger one (nested thresholds).

The largest mixture is the one at which some source is used max_repeats times whole. A source that
needs more than all its tokens is taken whole as often as fits, and the rest below its threshold.

Histograms have at most BUCKETS rows a source of the target table and level; the target table is
configuration of few rows, so these and the thresholds may be sent everywhere.

Defined results: documents of no tokens, of no source or of a source without target are not used;
a source without documents has share 0 and the others keep their proportions; a target share of 0
uses nothing; no documents give an empty mixture. The actual share of a source differs from its
target by less than one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm.tokens import token_counts
from sievelark.session import cut, table

#: Buckets of a histogram (2^BITS), and levels: BITS * LEVELS bits of hash.
BITS, LEVELS = 10, 6
#: Nested budgets, as shares of the largest mixture.
BUDGETS = (0.1, 0.25, 0.5, 1.0)


def hashed(counts: DataFrame) -> DataFrame:
    """Documents with tokens and their hash, a whole number of BITS * LEVELS bits."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(7)), 64 - BITS * LEVELS)
    return counts.where("n_tokens > 0 and source is not null").withColumn("h", h)


def thresholds(docs: DataFrame, needs: list[tuple[str, float, float]]) -> list[tuple[str, float, int]]:
    """(source, budget, hash) such that the documents of the source below the hash have the tokens needed, to within one document.

    needs: (source, budget, tokens)."""
    spark = docs.sparkSession
    open_ = {(s, b): (0, float(n)) for s, b, n in needs}
    found: dict[tuple[str, float], int] = {k: 0 for k, (_, n) in open_.items() if n <= 0}
    open_ = {k: v for k, v in open_.items() if k not in found}
    for level in range(LEVELS):
        if not open_:
            break
        shift = BITS * (LEVELS - level - 1)
        at = spark.createDataFrame([(s, b, p) for (s, b), (p, _) in open_.items()], "source string, budget double, prefix bigint")
        x = docs.join(F.broadcast(at), "source").where(F.shiftright("h", shift + BITS) == F.col("prefix")) if shift + BITS < 60 else docs.join(F.broadcast(at), "source")
        rows = x.groupBy("source", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")).collect()
        by: dict[tuple[str, float], list] = {}
        for r in rows:
            by.setdefault((r.source, r.budget), []).append((r.bucket, r.n, r.d))
        for k, (prefix, need) in list(open_.items()):
            total, hit = 0, None
            for bucket, n, d in sorted(by.get(k, [])):
                if total + n > need:
                    hit = (bucket, n, d)
                    break
                total += n
            if hit is None:
                found[k] = (prefix + 1) << (shift + BITS)
            elif hit[2] == 1 or level == LEVELS - 1:
                nearer = total + hit[1] - need < need - total
                found[k] = (hit[0] + nearer) << shift
            else:
                open_[k] = (hit[0], need - total)
                continue
            del open_[k]
    return [(s, b, h) for (s, b), h in found.items()]


def mixture(counts: DataFrame, targets: DataFrame, budgets: tuple[float, ...] = (1.0,)) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, budget, copies) of every document used, and (source, budget, wanted) with the tokens wanted of each source."""
    spark = counts.sparkSession
    docs = cut(hashed(counts).join(F.broadcast(targets.select("source").distinct()), "source"))
    have = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = [(r.source, r.target_share, max(1, r.max_repeats or 1)) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source in have and (r.target_share or 0) > 0]
    weight = sum(t for _, t, _ in rows)
    size = min((m * have[s] * weight / t for s, t, m in rows), default=0.0)
    wanted = [(s, float(b), size * b * t / weight) for s, t, _ in rows for b in budgets]
    needs = [(s, b, n - have[s] * int(n / have[s] + 1e-9)) for s, b, n in wanted]
    cap = {s: m for s, _, m in rows}
    times = {(s, b): min(cap[s], int(n / have[s] + 1e-9)) for s, b, n in wanted}
    limit = [(s, b, times[s, b], h if times[s, b] < cap[s] else 0) for s, b, h in thresholds(docs, needs)]
    plan = spark.createDataFrame(limit, "source string, budget double, times int, h_end bigint")
    used = docs.join(F.broadcast(plan), "source").withColumn("copies", F.col("times") + (F.col("h") < F.col("h_end")).cast("int"))
    return used.where("copies > 0").select("doc_id", "source", "n_tokens", "budget", "copies"), spark.createDataFrame(wanted, "source string, budget double, wanted double")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document used in the largest mixture: its tokens and how often it is used."""
    used, _ = mixture(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
    return used.select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each budget and source of the targets: documents, most copies of one, tokens, the share reached and its target."""
    targets = table(spark, sf_dir, "mix_targets")
    used, _ = mixture(token_counts(table(spark, sf_dir, "documents")), targets, BUDGETS)
    g = cut(used.groupBy("budget", "source").agg(F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens")))
    total = g.groupBy("budget").agg(F.sum("n_tokens").alias("all_tokens"))
    grid = targets.select("source", "target_share", F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget"))
    grid = grid.join(total, "budget").join(g, ["budget", "source"], "left").na.fill(0, ["n_docs", "most_copies", "n_tokens"])
    return grid.select("budget", "source", "target_share", "n_docs", "most_copies", "n_tokens", (F.col("n_tokens") / F.col("all_tokens")).alias("actual_share"))
