"""Fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: list[DataFrame], k: int = 2, limit: int = 10, query_col: str = "query_id", id_col: str = "id", weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), ranks from zero; lists carry ``rank`` from one."""
    parts = [x.select(query_col, id_col, (F.lit(float(w)) / (k + F.col("rank") - 1)).alias("part")) for x, w in zip(lists, weights or [1.0] * len(lists), strict=True)]
    return _best(reduce(DataFrame.unionByName, parts), limit, query_col, id_col)


def weighted(lists: list[DataFrame], weights: list[float], limit: int = 10, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """Weighted sum of scores, each list scaled to 0..1 within its query (all 1 where they are equal)."""
    parts = []
    for x, w in zip(lists, weights, strict=True):
        span = Window.partitionBy(query_col)
        low, high = F.min("score").over(span), F.max("score").over(span)
        scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
        parts.append(x.select(query_col, id_col, (scaled * float(w)).alias("part")))
    return _best(reduce(DataFrame.unionByName, parts), limit, query_col, id_col)


def _best(parts: DataFrame, limit: int, query_col: str, id_col: str) -> DataFrame:
    fused = parts.groupBy(query_col, id_col).agg(F.round(F.sum("part"), 6).alias("score"))
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(id_col))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def prefetch(k: int) -> int:
    """How many candidates each list gives before fusion."""
    return max(3 * k, 20)
