"""Exact quantiles and order statistics of groups of any size.

A plan declares what it knows about its groups. Groups that cannot grow with the table, as a day or a
window is part of their key, are ``bounded``: one aggregate with the built-in exact percentile. All
others go the way below, and if their aggregates are sums, bounds or means of the very column of the
quantiles, these come from the same counts (``weighted``), so that the input is read once.

Rows are counted per (group, value): partial counting on the map side, and a shuffle that spreads
even a single group over its values. Then the counts per bin locate the bins that hold the wanted
positions, and only those bins are ordered. Both ordered steps handle few rows per group: the bins
of a group, then the values of a bin. What way is taken never depends on how large some group is, and
building a plan starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stays are counted in microseconds; one-hour bins keep both ordered steps short.
HOUR_US = 3_600_000_000


def _positions(n: Column, q: float) -> tuple[Column, Column, Column]:
    at = (n - 1) * F.lit(float(q))
    return F.floor(at), F.ceil(at), at - F.floor(at)


def aggregate_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    value: Column,
    quantiles: Mapping[str, float],
    unit: float = 1.0,
    bin_width: int = HOUR_US,
    bounded: bool = False,
    weighted: Callable[[Column, Column], Sequence[Column]] | None = None,
) -> DataFrame:
    """Aggregates per group with interpolated quantiles of an integer column, divided by ``unit``.

    NULL values do not count; a group without any value is there with NULL quantiles. ``bounded``
    declares that no group grows with the table. ``weighted`` gives further aggregates from a column
    of different values and one of how often each occurs.
    """
    if bounded:
        exact = [(F.percentile(value, F.lit(q)) / F.lit(float(unit))).alias(name) for name, q in quantiles.items()]
        return df.groupBy(*keys).agg(*aggregates, *exact)
    counts = value_counts(df, keys, value, bin_width)
    spread = quantiles_of_counts(counts, list(keys), quantiles, unit)
    if weighted is not None:
        groups = counts.groupBy(*keys).agg(*weighted(F.col("_v"), F.col("_c")))
        if aggregates:
            groups = attach_quantiles(groups, df.groupBy(*keys).agg(*aggregates), keys)
    elif not keys and not aggregates:
        return spread
    else:
        groups = df.groupBy(*keys).agg(*aggregates) if aggregates else counts.select(*keys).distinct()
    return attach_quantiles(groups, spread, keys)


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, bin_width: int) -> DataFrame:
    """How often each value of a group occurs, NULL among them, with the value's bin."""
    counts = df.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    return counts.withColumn("_bin", F.floor(F.col("_v") / bin_width))


def distributed_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    quantiles: Mapping[str, float],
    bin_width: int = HOUR_US,
    unit: float = 1.0,
) -> DataFrame:
    """The quantiles alone, from counts per value.

    One row per group that has a non-NULL value (without keys: one row of NULLs if there is none).
    """
    return quantiles_of_counts(value_counts(df, keys, value, bin_width), list(keys), quantiles, unit)


def quantiles_of_counts(counts: DataFrame, keys: list[str], quantiles: Mapping[str, float], unit: float) -> DataFrame:
    """Quantiles per group from rows of a value ``_v``, how often it occurs ``_c``, and its ``_bin``."""
    # NULL values weigh nothing. A filter on them would reach below the counting and keep it from being shared.
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_c")).otherwise(0)).alias("_bc"))
        .withColumn("_end", F.sum("_bc").over(upto))
        .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
    )
    holds = F.lit(False)
    for q in quantiles.values():
        lo, hi, _ = _positions(F.col("_n"), q)
        for pos in (lo, hi):
            holds = holds | ((pos >= F.col("_start")) & (pos < F.col("_end")))
    wanted = bins.where(holds).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_b"), "_start", "_n")
    cond = F.col("_bin") == F.col("_b")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.join(wanted, cond)
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )

    def value_at(pos: Column) -> Column:
        return F.max(F.when((pos >= F.col("_lo")) & (pos < F.col("_hi")), F.col("_v")))

    out = []
    for name, q in quantiles.items():
        lo, hi, part = _positions(F.col("_n"), q)
        low, high = value_at(lo), value_at(hi)
        out.append(((low + (high - low) * F.max(part)) / F.lit(float(unit))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def value_at_share(df: DataFrame, keys: Sequence[str], value: Column, share: float, name: str, bin_width: int) -> DataFrame:
    """The value at position ``floor(share * n)`` (from 1) of each group, values in ascending order."""
    keys = list(keys)
    counts = (
        df.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
        .withColumn("_bin", F.floor(F.col("_v") / bin_width))
    )
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1)) - 1
    bins = (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_end", F.sum("_bc").over(upto))
        .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
        .where((pos >= F.col("_end") - F.col("_bc")) & (pos < F.col("_end")))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_b"), (F.col("_end") - F.col("_bc")).alias("_start"), "_n")
    )
    cond = F.col("_bin") == F.col("_b")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(bins, cond)
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(inside))
        .where((pos >= F.col("_hi") - F.col("_c")) & (pos < F.col("_hi")))
        .select(*keys, F.col("_v").alias(name))
    )


def attach_quantiles(groups: DataFrame, quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-group quantiles to a per-group table, NULL keys matching each other."""
    renamed = quantiles.select(*[F.col(k).alias(f"_q_{k}") for k in keys], *[c for c in quantiles.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_q_{k}"))
    return groups.join(renamed, cond, "left").drop(*[f"_q_{k}" for k in keys])
