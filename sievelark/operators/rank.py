"""Batches, model scores and ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sievelark.functions.text import json_array
from sievelark.operators.recall import numbered


class Scorer(Protocol):
    """Scores a batch of rows: returns one score in 0..10 and a reason a row."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def lexical_scorer(keywords: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The deterministic default: a point for each keyword in title or abstract, ten at most."""
    low = [k.lower() for k in keywords]

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        text = (batch["title"].fillna("") + " " + batch["abstract"].fillna("")).str.lower()
        n = sum((text.str.contains(k, regex=False).astype(int) for k in low), start=pd.Series(0, index=batch.index))
        return pd.DataFrame({"score": n.clip(upper=10).astype(float), "reason": n.astype(str) + " keywords"})

    return score


def score_with(df: DataFrame, scorer: Scorer, batch_rows: int = 10) -> DataFrame:
    """relevance_score (0..1) and filter_reason by a scorer that is called on batches of rows inside the tasks."""
    schema = StructType([*df.schema.fields, StructField("relevance_score", DoubleType()), StructField("filter_reason", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch_rows):
                part = b.iloc[i : i + batch_rows].reset_index(drop=True)
                got = scorer(part)
                yield part.assign(relevance_score=got["score"] / 10, filter_reason=got["reason"])

    return df.mapInPandas(run, schema)


def batches(df: DataFrame, order: list[Column], size: int = 10) -> DataFrame:
    """batch_id (from 0) and pos (from 1, inside the batch) by a total order."""
    n = numbered(df, order, "_n")
    return n.withColumns({"batch_id": F.floor((F.col("_n") - 1) / size), "pos": (F.col("_n") - 1) % size + 1}).drop("_n")


def parse_scores(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(batch_id, k, paper_num, score, reason) of the JSON arrays in answers; scores divided by ten, bad ones 0; items that are no objects or miss a field are left out.

    Of a batch holding a paper_num that is no whole number the items before it come out: `bad` marks such batches."""
    v = answers.select("batch_id", F.try_parse_json(json_array(F.col(column))).alias("v"))
    items = v.select("batch_id", F.posexplode_outer(F.try_variant_get("v", "$", "array<variant>")).alias("k", "x"))
    num, score = F.try_variant_get("x", "$.paper_num", "string"), F.try_variant_get("x", "$.score", "string")
    out = items.where(num.isNotNull() & score.isNotNull()).select("batch_id", "k", num.alias("_num"), F.coalesce(score.try_cast("double") / 10, F.lit(0.0)).alias("score"), F.coalesce(F.try_variant_get("x", "$.reason", "string"), F.lit("")).alias("reason"))
    bad = out.where(F.col("_num").try_cast("int").isNull()).groupBy("batch_id").agg(F.min("k").alias("_bad"))
    out = out.join(bad, "batch_id", "left").where(F.col("_bad").isNull() | (F.col("k") < F.col("_bad")))
    return out.select("batch_id", "k", F.col("_num").try_cast("int").alias("paper_num"), "score", "reason", F.col("_bad").isNotNull().alias("bad"))


def unusable(answers: DataFrame, column: str = "answer") -> DataFrame:
    """batch_id of the answers that cannot be used as a whole: no JSON array in them, or a paper_num that is no whole number."""
    broken = answers.where(F.try_variant_get(F.try_parse_json(json_array(F.col(column))), "$", "array<variant>").isNull()).select("batch_id")
    return broken.unionByName(parse_scores(answers, column).where("bad").select("batch_id")).distinct()


def with_fallback(rows: DataFrame, scores: DataFrame, answers: DataFrame) -> DataFrame:
    """Scored rows as by join_scores; of a batch with an unusable answer every row once, with the score given before the answer broke off, else its old one or 0."""
    bad = unusable(answers).withColumn("_bad", F.lit(True))
    old = {"relevance_score": F.lit(0.0), "filter_reason": F.lit("")}
    rows = rows.withColumns({c: v for c, v in old.items() if c not in rows.columns})
    plain = rows.drop(*old)
    good = join_scores(plain, scores.where("not bad"))
    part = scores.groupBy("batch_id", "paper_num").agg(F.max_by("score", "k").alias("_s"), F.max_by("reason", "k").alias("_r")).withColumnRenamed("paper_num", "pos")
    kept = rows.join(bad, "batch_id").join(part, ["batch_id", "pos"], "left")
    kept = kept.withColumns({"relevance_score": F.coalesce("_s", "relevance_score", F.lit(0.0)), "filter_reason": F.coalesce("_r", "filter_reason", F.lit(""))})
    return good.unionByName(kept.select(*good.columns))


def join_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of a batch that a score names by position; a position named twice gives the row twice, with the last score."""
    last = scores.groupBy("batch_id", "paper_num").agg(F.max_by("score", "k").alias("relevance_score"), F.max_by("reason", "k").alias("filter_reason"), F.count("*").alias("_times"))
    hit = rows.join(last, (rows["batch_id"] == last["batch_id"]) & (rows["pos"] == last["paper_num"])).drop(last["batch_id"], last["paper_num"])
    return hit.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_i", "_times")


def ranked(df: DataFrame, k: int, tie: str = "item_ord") -> DataFrame:
    """The k rows of highest relevance_score, ties in arrival order."""
    return df.orderBy(F.col("relevance_score").desc_nulls_last(), F.col(tie)).limit(k)
