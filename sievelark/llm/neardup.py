"""Near-duplicate texts by anchor-point covering.

A text is the set of its runs of SHINGLE words. Its fingerprint is CODES vectors of N = 5
min-hashes over the field of P elements. Anchors are the words of the single-parity-check code
of that length (all vectors whose coordinates sum to zero): its covering radius is 1, and the
anchors within the radius of a vector are the N vectors got by changing one coordinate so that
the sum is zero. Two vectors that differ in at most one coordinate meet at an anchor, as both
give the same word when the differing coordinate is the changed one, so replication to the
radius suffices for a threshold of one differing coordinate; one of CODES independent vectors has
to meet it. A pair of likeness s is missed with probability (1 - 5s^4 + 4s^5)^CODES: 7e-3 at 0.5,
1e-5 at 0.62, 1e-9 at 0.75; an unlike pair of 0.03 meets once in ten thousand. At each anchor,
texts are compared by BITS one-bit min-hashes, the survivors once by MORE of them, and what is
left by whole shingle sets.

Exact copies (equal shingle sets) are one representative before fingerprints are replicated, so
a third of all rows being one text is one row here. Per representative N * CODES rows of 24 bytes
are shuffled; candidates are joined to shingle sets by id. No bucket is collected: anchors are
joined, and adaptive execution splits skewed ones.

Defined results: null fields are empty; texts without any word pair with nothing; texts too short
for a run of words are alike only if their words are the same; repeated ids are distinct rows of
the input only if their text differs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.operators.components import connected_components
from sievelark.session import cut, fan_out, table

SHINGLE, LIKENESS = 3, 0.5
#: Independent fingerprint vectors, and their coordinates, each giving one anchor.
CODES, N = 24, 5
#: One-bit min-hashes compared at an anchor, and the most that may differ (3.5 deviations above the mean at likeness 0.5).
BITS, APART = 64, 28
#: Further ones compared once a candidate pair, and the most of all that may differ (4.5 deviations above).
MORE, ALL_APART = 128, 75
P = (1 << 31) - 1
_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 63, size=N * CODES + BITS + MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, size=N * CODES + BITS + MORE, dtype=np.uint64)
_POS = _RNG.integers(1, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, size=(CODES, N), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, size: int, cache: dict[str, int]) -> np.ndarray:
    """The distinct hashed runs of `size` words; for fewer words one hash of them all; none for no word."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    ids = []
    for w in words:
        if (h := cache.get(w)) is None:
            if len(cache) > 200_000:
                cache.clear()
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    a = np.array(ids, np.uint64)
    if len(a) < size:
        return np.array([xxhash.xxh3_64_intdigest("short " + " ".join(words))], np.uint64)
    total = np.zeros(len(a) - size + 1, np.uint64)
    for k in range(size):
        total = total + a[k : len(a) - size + 1 + k] * _POS[k]
    return np.unique(mix(total))


def shingle_sets(df: DataFrame, text: Column, size: int = SHINGLE) -> DataFrame:
    """id -> (id, copy_key, sh): sh is the sorted set of shingle hashes; texts with equal sets share copy_key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in filter(len, batches):
            sets = [shingles(t or "", size, cache) for t in b["text"]]
            keys = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            out = pd.DataFrame({"id": b["id"], "copy_key": keys, "sh": [s.view(np.int64) for s in sets]})
            yield out[[len(s) > 0 for s in sets]]

    return fan_out(df.select("id", text.alias("text"))).mapInPandas(run, "id bigint, copy_key bigint, sh array<bigint>")


def lowest(sets: pd.Series, first: int, last: int) -> np.ndarray:
    """The min-hashes number first to last of each set."""
    out = np.empty((len(sets), last - first), np.uint64)
    for i, s in enumerate(sets):
        h = np.asarray(s, np.int64).view(np.uint64)
        low = None
        for at in range(0, len(h), 4096):
            part = (h[at : at + 4096, None] * _MUL[None, first:last] + _ADD[None, first:last]).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out


def packed_bits(lows: np.ndarray) -> list[np.ndarray]:
    """One bit a min-hash, 64 to a number."""
    bits = (mix(lows) & np.uint64(1)).reshape(len(lows), -1, 64) << np.arange(64, dtype=np.uint64)[None, None, :]
    return [x.view(np.int64) for x in np.ascontiguousarray(bits.sum(axis=2, dtype=np.uint64).T)]


def anchors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(anchor, rep, bits) for each anchor within the covering radius of each of the rep's vectors."""
    with np.errstate(over="ignore"):
        for b in filter(len, batches):
            lows = lowest(b["sh"], 0, N * CODES + BITS)
            bits = packed_bits(lows[:, N * CODES :])[0]
            x = (mix(lows[:, : N * CODES]) % np.uint64(P)).reshape(-1, CODES, N)
            total = x.sum(axis=2)
            reps, out_a, out_r, out_b = b["rep"].to_numpy(), [], [], []
            for i in range(N):
                word = x.copy()
                word[:, :, i] = (np.uint64(P) * np.uint64(N) - (total - x[:, :, i])) % np.uint64(P)
                key = mix((word * _MIX[None, :, :]).sum(axis=2, dtype=np.uint64)).view(np.int64)
                out_a.append(key.ravel())
                out_r.append(np.repeat(reps, CODES))
                out_b.append(np.repeat(bits, CODES))
            yield pd.DataFrame({"anchor": np.concatenate(out_a), "rep": np.concatenate(out_r), "bits": np.concatenate(out_b)})


def sketches_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(rep, s0, s1): the MORE one-bit min-hashes of each rep."""
    with np.errstate(over="ignore"):
        for b in filter(len, batches):
            s0, s1 = packed_bits(lowest(b["sh"], N * CODES + BITS, N * CODES + BITS + MORE))
            yield pd.DataFrame({"rep": b["rep"].to_numpy(), "s0": s0, "s1": s1})


def near_pairs(reps: DataFrame, likeness: float = LIKENESS, apart: int = APART, all_apart: int = ALL_APART) -> DataFrame:
    """(a, b, likeness) with a < b for all representatives (rep, sh) at least `likeness` alike."""
    placed = reps.mapInPandas(anchors_of, "anchor bigint, rep bigint, bits bigint")
    x = placed.select("anchor", F.col("rep").alias("a"), F.col("bits").alias("x"))
    y = placed.select("anchor", F.col("rep").alias("b"), F.col("bits").alias("y"))
    differ = lambda u, v: F.bit_count(F.col(u).bitwiseXOR(F.col(v)))
    met = x.join(y, "anchor").where(F.col("a") < F.col("b")).select("a", "b", differ("x", "y").alias("d")).where(F.col("d") <= apart).distinct()
    sketch = cut(reps.mapInPandas(sketches_of, "rep bigint, s0 bigint, s1 bigint"))
    side = lambda k, u: sketch.select(F.col("rep").alias(k), F.col("s0").alias(u + "0"), F.col("s1").alias(u + "1"))
    met = met.join(side("a", "u"), "a").join(side("b", "v"), "b").where(F.col("d") + differ("u0", "v0") + differ("u1", "v1") <= all_apart)
    met = cut(met.select("a", "b"))
    a, b = reps.select(F.col("rep").alias("a"), F.col("sh").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    exact = met.join(a, "a").join(b, "b").withColumn("both", both)
    exact = exact.withColumn("likeness", F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")))
    return exact.where(F.col("likeness") >= likeness).select("a", "b", "likeness")


def linked(df: DataFrame, text: Column, size: int = SHINGLE, likeness: float = LIKENESS, apart: int = APART) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row with a word, and the near pairs of representatives."""
    sets = cut(shingle_sets(df, text, size))
    rep = sets.groupBy("copy_key").agg(F.min("id").alias("rep"))
    member = cut(sets.select("id", "copy_key").join(rep, "copy_key").select("id", "rep"))
    firsts = member.where("id = rep").distinct()
    reps = sets.join(firsts, "id").select(F.col("id").alias("rep"), "sh")
    return member, cut(near_pairs(cut(reps), likeness, apart))


def papers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "papers").select(F.col("item_ord").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))).alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of papers rows at least half alike in runs of three words, copies included."""
    member, near = linked(papers_text(spark, sf_dir), F.col("text"))
    m = lambda r, i: member.select(F.col("rep").alias(r), F.col("id").alias(i))
    far = near.join(m("a", "x"), "a").join(m("b", "y"), "b").select("x", "y")
    same = m("a", "x").join(m("a", "y"), "a").where("x < y").select("x", "y")
    return far.unionByName(same).select(F.least("x", "y").alias("item_ord_a"), F.greatest("x", "y").alias("item_ord_b")).distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a paper: its class (the class's lowest item_ord), its copies and its number of links."""
    member, near = linked(papers_text(spark, sf_dir), F.col("text"))
    roots = connected_components(near, "a", "b")
    size = member.groupBy("rep").agg(F.count("*").alias("n_copies"))
    ends = near.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    links = ends.join(size.select(F.col("rep").alias("other"), F.col("n_copies").alias("n")), "other").groupBy("rep").agg(F.sum("n").alias("n"))
    info = size.join(links, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    info = info.select("rep", F.coalesce("root", "rep").alias("class_id"), "n_copies", (F.col("n_copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return member.join(info, "rep").select(F.col("id").alias("item_ord"), "class_id", "n_copies", "n_links")
