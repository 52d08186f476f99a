"""Rank-based operators beyond plain top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordinal(scored: DataFrame, key: str, linked: Column, at: str, *, head: int = 20, newest: bool = False) -> DataFrame:
    """``place``: of the ``head`` best, those linked to the subject in time order,
    then the others by score, then the tail.  ``scored`` is a bounded result list."""
    w = Window.orderBy(F.desc("score"), key)
    r = scored.withColumn("_r", F.row_number().over(w)).withColumn("_l", linked & (F.col("_r") <= head))
    bucket = F.when(F.col("_r") > head, 2).when(F.col("_l"), 0).otherwise(1)
    time = F.when(F.col("_l"), F.col(at))
    order = Window.orderBy(bucket, time.desc() if newest else time.asc(), "_r")
    return r.withColumn("place", F.row_number().over(order)).drop("_r", "_l")


def representatives(scored: DataFrame, subject: str, at: str, newest: bool = False) -> DataFrame:
    """The earliest (or latest) row of each subject."""
    rest = F.struct(*scored.columns)
    pick = F.max_by if newest else F.min_by
    return scored.groupBy(subject).agg(pick(rest, at).alias("_x")).select("_x.*")


def per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k first of each group; Spark keeps k rows per group and task before the
    shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def fraction(df: DataFrame, key: str, score: str, share: float) -> DataFrame:
    """The best max(1, floor(n * share)) rows: n is one count, the rest a top-k."""
    k = max(1, int(df.count() * share))
    return df.orderBy(F.desc(score), key).limit(k)


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Lower nearest-rank percentiles: the value at floor(q * (n - 1)) in order."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    r = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": n})
    return r.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value))).alias(f"p{round(q * 100)}") for q in qs])
