"""Recommendation by vectors: the rows nearest to what is liked and farthest from what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroid(df: DataFrame, vector: str = "embedding") -> list[float]:
    """The mean vector, summed by position with map-side combine; as many numbers as a vector has come to the driver."""
    each = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return [r.x for r in each.orderBy("i").collect()]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def recommend(df: DataFrame, liked: Column, disliked: Column, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k other rows by cosine with mean(liked) - mean(disliked). The query vector is a constant of the plan; a top-k ends it."""
    v = df.withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    up, down = centroid(v.where(liked), "_v"), centroid(v.where(disliked), "_v")
    size = max(len(up), len(down))
    query = [a - b for a, b in zip(up or [0.0] * size, down or [0.0] * size, strict=True)]
    x = v.where(~(liked | disliked)).withColumn("_q", F.array(*map(F.lit, query)).cast("array<double>"))
    norm = F.sqrt(dot(F.col("_v"), F.col("_v"))) * F.sqrt(dot(F.col("_q"), F.col("_q")))
    return x.withColumn("score", F.try_divide(dot(F.col("_v"), F.col("_q")), norm)).orderBy(F.col("score").desc_nulls_last(), F.col(key)).limit(k).drop("_v", "_q")
