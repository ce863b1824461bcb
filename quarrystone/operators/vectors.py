"""Vector operators. Vectors are stored as floats and computed as doubles; scores are rounded to six decimals before
ranking, ties go to the smaller id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; vectors shorter than 1e-12 are divided by that."""
    parts = v.cast("array<double>")
    # the length is bound once: written into the inner lambda it would be taken anew for every part
    bound = F.array(F.greatest(norm(v), F.lit(TINY)))
    return F.element_at(F.transform(bound, lambda n: F.transform(parts, lambda x: x / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def rounded(score: Column) -> Column:
    return F.round(score, DIGITS)


def or_zero(v: Column, dims: int) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(0.0), dims))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows with their ``rank`` (from 1): score rounded and descending, then key. Null scores come last."""
    best = scored.withColumn(score, rounded(F.col(score))).orderBy(F.desc_nulls_last(score), key).limit(max(0, k))
    # at most k rows are left to number
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), key)))


def top_k_each(scored: DataFrame, group: str, k: int, score: str, key: str) -> DataFrame:
    """The k best rows of every group with their ``rank``; partial ranks are cut before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), key)
    return scored.withColumn(score, rounded(F.col(score))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_by_query(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score, rank): the k vectors most similar to one query vector."""
    return top_k(scored(vectors, query), k)


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, score): the cosine of every vector with one query vector, whose length is taken here."""
    length = max(math.sqrt(sum(float(x) ** 2 for x in query)), TINY)
    q = F.array(*[F.lit(float(x) / length) for x in query])
    return vectors.select("id", (dot(F.col("vec"), q) / F.greatest(norm(F.col("vec")), F.lit(TINY))).alias("score"))


def mean_vectors(members: DataFrame, vectors: DataFrame, group: str, member: str, dims: int) -> DataFrame:
    """(group, vec): the normalised mean of the members' vectors; members without a vector don't count.

    One running sum for each dimension is kept in the aggregate, so a group's vectors are combined before the
    shuffle and never collected.
    """
    met = members.join(vectors.select(F.col("id").alias(member), "vec"), member)
    sums = met.groupBy(group).agg(*[F.avg(F.get("vec", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dims)])
    mean = F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(dims)])
    return sums.select(group, normalise(mean).alias("vec"))
