"""Has a key been seen before? Minimal perfect hashing per sealed partition.

Keys seen before the seal time are distributed by hash into partitions of about PART_KEYS keys.
Each partition becomes one row of a stored generation: a minimal perfect hash (levels of
collision-free bits, about 3.7 bits a key) plus, per slot, a FP_BITS fingerprint and the second
first seen, about 6.5 bytes a key. No key text is kept. Generations lie in a folder: a later run
opens it and seals only what has come since. Keys since the last seal are an exact set. A probe
computes the slot and compares the fingerprint: no false "no", a false "yes" for about 2^-FP_BITS of
the absent keys; the measured rate is reported by `p7_rates`, and `p7_found` removes those by joining
the few "yes" keys to the exact keys.

Probe keys are made distinct first, so a key on a third of all rows is probed once. A partition is
built in one task of bounded size; where many probes meet few partitions, a partition is copied to as
many tasks as keep each at about PART_KEYS probes. Partitions are never brought to the driver.

Defined results: null, blank and prefix-only ids match nothing; an id is the same in any letter
case, with any prefix, surrounding space or version; repeated rows give one answer; a key first
seen at or after the row's time does not count."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.session import cut, list_dir, micros, remove, shared_dir, table

#: Keys in a sealed partition and probes in a task, about; bits of a fingerprint; bits of a level per key left; days kept as an open exact set.
PART_KEYS, FP_BITS, GAMMA, OPEN_DAYS = 20_000, 16, 2.0, 2
_LEVELS = 48


def key_of(c: Column) -> Column:
    """An id without prefixes, letter case, space or paper version; null if nothing is left."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"^(?:(?:semantic|arxiv|corpusid|s2|doi)\s*:\s*)+", "")
    s = F.when(s.rlike(r"^(\d{4}\.\d{4,5}|[a-z\-]+(\.[a-z]{2})?/\d{7})v\d+$"), F.regexp_replace(s, r"v\d+$", "")).otherwise(s)
    return F.when(s != "", s)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & ((1 << 64) - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit values: values 0..n-1 for members, a slot or -1 for others."""

    def __init__(self, sizes: np.ndarray, bits: bytes, rest: np.ndarray):
        self.sizes, self.rest = sizes, rest
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))
        self.flat = flat
        self.rank = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        left, sizes, parts = h, [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            m = max(8, int(GAMMA * len(left)))
            at = (_mix(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        return cls(np.array(sizes, np.int64), np.packbits(flat).tobytes(), np.sort(left))

    def slot(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(h[open_], level) % np.uint64(m)).astype(np.int64) + self.start[level]
            hit = self.flat[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[open_]), len(self.rest) - 1)
            hit = self.rest[at] == h[open_]
            out[open_[hit]] = self.rank[-1] + at[hit]
        return out


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 1000) >> np.uint64(64 - FP_BITS)).astype(np.uint16)


_SEALED = "part int, n bigint, sizes binary, bits binary, rest binary, prints binary, base bigint, first binary"


def sealed_partitions(keys: DataFrame, parts: int) -> DataFrame:
    """(key, first_us), keys distinct -> one row a partition, holding no key."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_us").drop_duplicates("h")  # two keys of one 64-bit hash share its earliest time
        h = pdf["h"].to_numpy(np.int64).view(np.uint64)
        f = PerfectHash.build(h)
        slot = f.slot(h)
        second = pdf["first_us"].to_numpy(np.int64) // 1_000_000
        base = int(second.min())
        wide = np.int64 if int(second.max()) - base >> 32 else np.uint32
        prints, first = np.empty(len(h), np.uint16), np.empty(len(h), wide)
        prints[slot], first[slot] = fingerprint(h), (second - base).astype(wide)
        bits = np.packbits(f.flat).tobytes()
        return pd.DataFrame([(int(pdf["part"].iloc[0]), len(h), f.sizes.tobytes(), bits, f.rest.tobytes(), prints.tobytes(), base, first.tobytes())], columns=[c.split()[0] for c in _SEALED.split(", ")])

    hashed = keys.select("first_us", F.xxhash64("key").alias("h")).withColumn("part", _part(parts))
    return hashed.groupBy("part").applyInPandas(build, _SEALED)


def _part(parts: int) -> Column:
    return F.pmod(F.hash("h"), F.lit(parts)).cast("int")


def _probe(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """The keys of one task's probes that one sealed partition answers yes to."""
    if not len(q) or not len(s):
        return pd.DataFrame({"key": pd.Series(dtype=str), "first_s": pd.Series(dtype="int64")})
    r = s.iloc[0]
    n = int(np.frombuffer(r["sizes"], np.int64).sum())
    f = PerfectHash(np.frombuffer(r["sizes"], np.int64), r["bits"], np.frombuffer(r["rest"], np.uint64))
    f.flat = f.flat[:n]
    h = q["h"].to_numpy(np.int64).view(np.uint64)
    slot = f.slot(h)
    at = np.maximum(slot, 0)
    yes = (slot >= 0) & (np.frombuffer(r["prints"], np.uint16)[at] == fingerprint(h))
    first = np.frombuffer(r["first"], np.uint32 if len(r["first"]) == 4 * r["n"] else np.int64)
    return pd.DataFrame({"key": q["key"][yes], "first_s": first[at[yes]].astype(np.int64) + r["base"]})


class Sealed:
    """Generations of sealed partitions in a folder that all executors share, one sub-folder each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generations(self) -> list[tuple[int, int, int]]:
        """(number, partitions, end in microseconds) of each generation, in order."""
        return sorted(tuple(map(int, n.split("_")[1:])) for n in list_dir(self.spark, self.path) if n.startswith("gen_"))

    def end(self) -> int | None:
        """Up to when keys are sealed."""
        return max((e for _, _, e in self.generations()), default=None)

    def seal(self, keys: DataFrame, until: int, part_keys: int = PART_KEYS) -> None:
        """Adds a generation of the keys (key, first_us) first seen since the last one's end and before `until`."""
        since, number = self.end(), len(self.generations())
        keys = keys.where(F.col("first_us") < until) if since is None else keys.where((F.col("first_us") >= since) & (F.col("first_us") < until))
        parts = max(1, math.ceil(keys.count() / part_keys))
        sealed_partitions(keys, parts).write.parquet(f"{self.path}/gen_{number}_{parts}_{until}")

    def ask(self, keys: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
        """(key, first_s) for the distinct keys that a generation answers yes to, with the earliest second."""
        keys = cut(keys.select("key", F.xxhash64("key").alias("h")))
        n, out = keys.count(), None
        for number, parts, until in self.generations():
            copies = max(1, math.ceil(n / (parts * part_keys)))
            stored = self.spark.read.schema(_SEALED).parquet(f"{self.path}/gen_{number}_{parts}_{until}")
            stored = stored.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            asked = keys.withColumns({"part": _part(parts), "copy": F.pmod(F.xxhash64("h"), F.lit(copies)).cast("int")})
            yes = asked.groupBy("part", "copy").cogroup(stored.groupBy("part", "copy")).applyInPandas(_probe, "key string, first_s bigint")
            out = yes if out is None else out.unionByName(yes)
        if out is None:
            return self.spark.createDataFrame([], "key string, first_s bigint")
        return out.groupBy("key").agg(F.min("first_s").alias("first_s"))

    def drop(self) -> None:
        remove(self.spark, self.path)


def memory_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, first_us): the different keys of the memory and when each was first seen."""
    m = table(spark, sf_dir, "semantic_scholar_memory").select(key_of(F.col("seen")).alias("key"), micros(F.col("seen_at")).alias("us"))
    return m.where("key is not null and us is not null").groupBy("key").agg(F.min("us").alias("first_us"))


def paper_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_ord, at_us, key): the one or two keys of each paper."""
    p = table(spark, sf_dir, "papers").select("item_ord", micros(F.col("fetched_at")).alias("at_us"), F.explode(F.array(key_of(F.col("arxiv_id")), key_of(F.col("semantic_paper_id")))).alias("key"))
    return p.where("key is not null")


def answers(spark: SparkSession, memory: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key) of the keys answered yes: by the sealed partitions, and by the open exact set."""
    top = memory.agg(F.max("first_us").alias("m")).first().m or 0
    at = top - OPEN_DAYS * 86_400_000_000
    keys = asked.select("key").distinct()
    store = Sealed(spark, f"{shared_dir(spark).rstrip('/')}/seen_{uuid.uuid4().hex[:12]}")
    try:
        store.seal(memory, at)
        old = cut(store.ask(keys).select("key"))
    finally:
        store.drop()
    return old, memory.where(F.col("first_us") >= at).join(keys, "key").select("key")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of which an id was seen before they were fetched; wrong yeses are removed by an exact look at the yes keys."""
    memory, asked = cut(memory_keys(spark, sf_dir)), paper_keys(spark, sf_dir)
    old, new = answers(spark, memory, asked)
    yes = memory.join(old.unionByName(new), "key", "left_semi")
    return asked.join(yes, "key").where("first_us < at_us").select("item_ord").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sealed partitions' answers against the truth: keys asked, seen, answered yes, wrong yeses and noes, and the rate of wrong yeses."""
    memory, asked = cut(memory_keys(spark, sf_dir)), paper_keys(spark, sf_dir)
    old, new = answers(spark, memory, asked)
    keys = asked.select("key").distinct()
    yes = old.unionByName(new).distinct().withColumn("yes", F.lit(1))
    all_ = keys.join(yes, "key", "left").join(memory.select("key", F.lit(1).alias("seen")), "key", "left").select(F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("seen", F.lit(0)).alias("seen"))
    r = all_.agg(F.count("*").alias("n_asked"), F.coalesce(F.sum("seen"), F.lit(0)).alias("n_seen"), F.coalesce(F.sum("yes"), F.lit(0)).alias("n_yes"), F.count_if(F.col("yes") > F.col("seen")).alias("n_wrong_yes"), F.count_if(F.col("yes") < F.col("seen")).alias("n_wrong_no"))
    return r.withColumn("wrong_yes_rate", F.coalesce(F.try_divide(F.col("n_wrong_yes"), F.col("n_asked") - F.col("n_seen")), F.lit(0.0)))
