"""Sorting, top-k, paging and set helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X


def sort_keys(keys: Sequence[str]) -> list[Column]:
    """``["a", "-b"]``: ascending with NULLs last, descending with NULLs first."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def order_pg(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*sort_keys(keys))


def order_by_bucket(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    """Sorts by the place of a label in ``labels``."""
    return df.orderBy(X.bucket_order(col, labels))


def top_k(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First k rows. The last key should be unique, else ties are cut arbitrarily."""
    return order_pg(df, keys).limit(k)


def page(df: DataFrame, keys: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    return order_pg(df, keys).offset(offset).limit(limit)


def top_n(df: DataFrame, by: str, n: int, partition: Sequence[str] = ()) -> DataFrame:
    """Rows with rank <= n in descending order of ``by``; ties share a rank and are all kept.

    Without a partition the n-th largest value is found by a distributed top-k, and only rows
    from it upwards are ranked.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(F.col(by).desc_nulls_last())
        return df.withColumn("rank", F.rank().over(w).cast("bigint")).where(F.col("rank") <= n)
    bar = df.where(F.col(by).isNotNull()).orderBy(F.desc(by)).limit(n).agg(F.min(by)).scalar()
    ranked = df.where(F.col(by) >= bar)
    better = ranked.groupBy(by).agg(F.count("*").alias("_c"))
    w = Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = better.select(by, (F.coalesce(F.sum("_c").over(w), F.lit(0)) + 1).alias("rank"))
    return ranked.join(ranks, by)


def arg_max(df: DataFrame, col: str, by: str) -> DataFrame:
    """The value of ``col`` where ``by`` is largest; ties go to the smallest value."""
    best = df.groupBy(col).agg(F.max(by).alias("_by")).orderBy(F.desc("_by"), col).limit(1)
    return best.select(col, F.col("_by").alias(by))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row aggregates side by side: a scalar subquery each, so each input is read once."""
    rows = [f.select(F.struct(*f.columns)).scalar().alias(f"r{i}") for i, f in enumerate(frames)]
    return frames[0].sparkSession.range(1).select(*rows).select(*[f"r{i}.*" for i in range(len(frames))])
