"""Neighbours and running sums within a key that stay parallel when one key is huge.

A window ``PARTITION BY key`` puts all rows of a key into one task. Here a key above a
threshold is cut into day slices, and each slice gets one or two extra rows that carry what
the window needs from its neighbours: the first row of the next slice, the last row of the
previous one, the sums of all earlier ones. Rows and carry rows go through one shuffle by
(key, slice); the carry rows are dropped after the window. Keys below the threshold have a
single slice and no carry rows.

What a carry table holds per key is bounded by the number of days, not by the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot with at least HOT_MIN_ROWS rows, unless HOT_KEYS others have more: a key that does
# not make the list holds less than 1 / HOT_KEYS of all rows. The list is short by construction,
# so it may come to the driver and be broadcast.
HOT_MIN_ROWS = 1_000_000
HOT_KEYS = 10_000

_SLICE, _HOT, _POS = "_slice", "_hot", "_pos"
_BEFORE, _ROW, _AFTER = 0, 1, 2

HotKeys = list[tuple]


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None, most: int = HOT_KEYS) -> HotKeys:
    """The largest keys, at most ``most`` of them, found by one counting job over the key columns.

    Usually the list is empty, and the caller can use a plain window.
    """
    bar = HOT_MIN_ROWS if min_rows is None else min_rows
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= bar)
    return [tuple(row)[:-1] for row in counts.orderBy(F.desc("_n")).limit(most).collect()]


def mark_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> DataFrame:
    """Adds ``_hot``: whether the row's key is on the list."""
    if not hot:
        return df.withColumn(_HOT, F.lit(False))
    types = ", ".join(f"_h_{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    known = df.sparkSession.createDataFrame(hot, types).withColumn(_HOT, F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return (
        df.join(F.broadcast(known), cond, "left")
        .drop(*[f"_h_{k}" for k in keys])
        .withColumn(_HOT, F.coalesce(_HOT, F.lit(False)))
    )


def ordered_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    following: Sequence[str] = (),
    previous: Sequence[str] = (),
    running: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    at_first: Mapping[str, Column] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Adds neighbour values and running sums of the rows of each key.

    ``order`` starts with a timestamp or date column and must be unique within a key.
    ``following`` / ``previous``: columns to take from the next / previous row, as
    ``next_<c>`` / ``prev_<c>``. ``running`` sums up to and with the row, ``before`` without it.
    ``at_first`` gives the value of an expression at the first row of the key. ``hot`` are the
    keys to cut into day slices; left out, they are looked up with ``hot_keys``.
    """
    running, before, at_first = dict(running or {}), dict(before or {}), dict(at_first or {})
    sums = {**running, **before}
    keys, order = list(keys), list(order)
    rows = df
    for name, delta in sums.items():
        rows = rows.withColumn(f"_d_{name}", delta)
    for name, value in at_first.items():
        rows = rows.withColumn(f"_f_{name}", value)

    hot = hot_keys(df, keys) if hot is None else hot
    if hot:
        rows = mark_hot(rows, keys, hot).withColumn(_SLICE, F.when(F.col(_HOT), F.to_date(order[0])))
        carry = _carry_rows(rows.where(_HOT), keys, order, following, previous, list(sums), list(at_first))
        rows = rows.drop(_HOT).withColumn(_POS, F.lit(_ROW))
        for part in carry:
            rows = rows.unionByName(part, allowMissingColumns=True)
        w = Window.partitionBy(*keys, _SLICE).orderBy(_POS, *order)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    added = {f"next_{c}": F.lead(c).over(w) for c in following}
    added.update({f"prev_{c}": F.lag(c).over(w) for c in previous})
    added.update({name: F.coalesce(F.sum(f"_d_{name}").over(upto), F.lit(0)) for name in running})
    added.update({name: F.coalesce(F.sum(f"_d_{name}").over(earlier), F.lit(0)) for name in before})
    added.update({name: F.first(f"_f_{name}").over(upto) for name in at_first})
    out = rows.select("*", *[c.alias(name) for name, c in added.items()])
    if hot:
        out = out.where(F.col(_POS) == _ROW)
    return out.select(*df.columns, *added)


def _carry_rows(
    rows: DataFrame, keys: list[str], order: list[str], following: Sequence[str], previous: Sequence[str],
    sums: list[str], at_first: list[str],
) -> list[DataFrame]:
    """What the slices of the hot keys hand to each other, as rows placed before or behind a slice."""

    def line(fields: Sequence[str]) -> Column:
        return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in fields])

    slices = rows.groupBy(*keys, _SLICE).agg(
        F.min(line(following)).alias("_first"),
        F.max(line(previous)).alias("_last"),
        *[F.sum(f"_d_{name}").alias(f"_d_{name}") for name in sums],
        *[F.min_by(f"_f_{name}", line(())).alias(f"_f_{name}") for name in at_first],
    )
    by_day = Window.partitionBy(*keys).orderBy(_SLICE)
    past = by_day.rowsBetween(Window.unboundedPreceding, -1)

    def unpack(df: DataFrame, fields: Sequence[str], *more: str) -> DataFrame:
        own = [F.col(f"_carry.{c}").alias(c) for c in fields if c not in keys]
        return df.where(F.col("_carry").isNotNull()).select(*keys, _SLICE, _POS, *own, *more)

    parts = []
    if previous or sums or at_first:
        ahead = slices.select(
            *keys, _SLICE, F.lit(_BEFORE).alias(_POS), F.lag("_last").over(by_day).alias("_carry"),
            *[F.sum(f"_d_{name}").over(past).alias(f"_d_{name}") for name in sums],
            *[F.first(f"_f_{name}").over(past).alias(f"_f_{name}") for name in at_first],
        )
        parts.append(unpack(ahead, previous, *[f"_d_{n}" for n in sums], *[f"_f_{n}" for n in at_first]))
    if following:
        behind = slices.select(
            *keys, _SLICE, F.lit(_AFTER).alias(_POS), F.lead("_first").over(by_day).alias("_carry")
        )
        parts.append(unpack(behind, following))
    return parts


def nearest_target(
    probes: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    target_time: str,
    fields: Sequence[str],
    forward: bool = True,
    hot: HotKeys | None = None,
) -> DataFrame:
    """For every probe and every target row the nearest target of its key in one direction of time.

    Forward: for a probe the first target at or after ``probe_time``, for a target the next one.
    Backward: for a probe the last target at or before its time, for a target the previous one.
    Returns all rows with ``is_probe`` and ``hit``: a struct of ``time`` and the target's ``fields``,
    by which targets at one time are ordered, or NULL. Linear in the rows: one sort per slice, no
    pairs.
    """
    return _nearest(probes, targets, list(keys), probe_time, target_time, fields, forward, hot).drop("_t")


def _nearest(
    probes: DataFrame, targets: DataFrame, keys: list[str], probe_time: str, target_time: str, fields: Sequence[str], forward: bool,
    hot: HotKeys | None,
) -> DataFrame:
    both = probes.select("*", F.lit(True).alias("is_probe"), F.col(probe_time).alias("_t")).unionByName(
        targets.select("*", F.lit(False).alias("is_probe"), F.col(target_time).alias("_t")), allowMissingColumns=True
    )
    as_target = F.struct(F.col("_t").alias("time"), *fields)
    rows = both.withColumn("_target", F.when(~F.col("is_probe"), as_target))
    turn = F.desc if forward else F.asc
    # At equal times targets come before the probes that may use them.
    order = [turn("_t"), F.col("is_probe"), *[turn(f) for f in fields]]
    hot = hot_keys(both, keys) if hot is None else hot
    if hot:
        rows = mark_hot(rows, keys, hot).withColumn(_SLICE, F.when(F.col(_HOT), F.to_date("_t")))
        edge = F.min("_target") if forward else F.max("_target")
        slices = rows.where(_HOT).groupBy(*keys, _SLICE).agg(edge.alias("_target"))
        passed = Window.partitionBy(*keys).orderBy(turn(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        carry = slices.select(
            *keys, _SLICE, F.lit(_BEFORE).alias(_POS), F.last("_target", ignorenulls=True).over(passed).alias("_target")
        ).where(F.col("_target").isNotNull())
        rows = rows.drop(_HOT).withColumn(_POS, F.lit(_ROW)).unionByName(carry, allowMissingColumns=True)
        w = Window.partitionBy(*keys, _SLICE).orderBy(_POS, *order)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("hit", F.last("_target", ignorenulls=True).over(behind))
    if hot:
        out = out.where(F.col(_POS) == _ROW)
    return out.select(*both.columns, "hit")


def next_two_targets(
    probes: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    target_time: str,
    fields: Sequence[str],
    hot: HotKeys | None = None,
) -> DataFrame:
    """``nearest_target`` forward, with ``behind``: the target after the one in ``hit``.

    A target carries the one after it along, so the second look needs no more than the first: both
    windows share one sort. For hot keys the days' last targets are handed on twice, the second time
    with what they carry.
    """
    keys = list(keys)
    hot = hot_keys(targets, keys) if hot is None else hot
    rows = _nearest(probes, targets, keys, probe_time, target_time, fields, True, hot)
    columns = [c for c in rows.columns if c != "_t"]
    carried = F.struct(F.col("_t").alias("time"), *[F.col(f).alias(f"_{f}") for f in fields], F.col("hit").alias("behind"))
    rows = rows.withColumn("_target", F.when(~F.col("is_probe"), carried))
    order = [F.desc("_t"), F.col("is_probe"), *[F.desc(f) for f in fields]]
    if hot:
        rows = mark_hot(rows, keys, hot).withColumn(_SLICE, F.when(F.col(_HOT), F.to_date("_t")))
        place = F.struct("_t", *fields)
        slices = rows.where(F.col(_HOT) & F.col("_target").isNotNull()).groupBy(*keys, _SLICE).agg(F.min_by("_target", place).alias("_target"))
        every = rows.where(_HOT).select(*keys, _SLICE).distinct().join(slices, [*keys, _SLICE], "left")
        passed = Window.partitionBy(*keys).orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        carry = every.select(
            *keys, _SLICE, F.lit(_BEFORE).alias(_POS), F.last("_target", ignorenulls=True).over(passed).alias("_target")
        ).where(F.col("_target").isNotNull())
        rows = rows.drop(_HOT).withColumn(_POS, F.lit(_ROW)).unionByName(carry, allowMissingColumns=True)
        w = Window.partitionBy(*keys, _SLICE).orderBy(_POS, *order)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
    last = F.last("_target", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("behind", last["behind"])
    if hot:
        out = out.where(F.col(_POS) == _ROW)
    return out.select(*columns, "behind")


def trailing_count(
    df: DataFrame, keys: Sequence[str], time_col: str, days: int, name: str, hot: HotKeys | None = None
) -> DataFrame:
    """Rows of the key in the last ``days`` days up to and with the row's own time.

    Hot keys are cut into blocks of ``days`` days. A row is sent to its own block and, as
    context, to the following one: the frame of any row lies within these two.
    """
    keys = list(keys)
    rows = df.withColumn("_us", F.unix_micros(F.col(time_col).cast("timestamp")))
    hot = hot_keys(df, keys) if hot is None else hot
    parts = list(keys)
    if hot:
        block = F.floor(F.col("_us") / (days * 86_400_000_000))
        rows = mark_hot(rows, keys, hot).withColumn("_own", F.when(F.col(_HOT), block))
        reach = F.when(F.col(_HOT), F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
        rows = rows.withColumn(_SLICE, F.explode(reach))
        parts.append(_SLICE)
    frame = Window.partitionBy(*parts).orderBy("_us").rangeBetween(-days * 86_400_000_000, Window.currentRow)
    out = rows.withColumn(name, F.count("*").over(frame))
    if hot:
        out = out.where(F.col("_own").eqNullSafe(F.col(_SLICE)))
    return out.select(*df.columns, name)
