"""Type-2 history of a dimension: reading versions and merging changes.

Columns every dimension here has: ``valid_from``, ``valid_to``, ``is_current``,
``record_version``, ``created_at``, ``updated_at``, and a surrogate key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.ordered import HotKeys, hot_keys, ordered_rows
from wardline.sources.tables import latest_per_key, materialize

# Fixed value: end of a version that is still valid.
OPEN_END = "9999-12-31 23:59:59"
BUCKETS = 4096


# --- reading ------------------------------------------------------------------------------------


def version_pairs(dim: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Version n beside version n+1, columns prefixed ``old_`` and ``new_``.

    A join on (key, version): unlike a window over the key it spreads the versions of one
    key over all tasks.
    """
    wanted = [key, "record_version", *columns]
    old = dim.select(*[F.col(c).alias(f"old_{c}") for c in wanted])
    new = dim.select(*[F.col(c).alias(f"new_{c}") for c in wanted])
    cond = (F.col(f"old_{key}") == F.col(f"new_{key}")) & (F.col("new_record_version") == F.col("old_record_version") + 1)
    return old.join(new, cond)


def insurance_changes(dim: DataFrame, after: str | None = None) -> DataFrame:
    pairs = version_pairs(dim, "patient_id", ["first_name", "last_name", "insurance_type", "valid_from"])
    changed = pairs.where(F.col("old_insurance_type") != F.col("new_insurance_type"))
    if after is not None:
        changed = changed.where(F.col("new_valid_from") > X.ts(after))
    return changed.select(
        F.col("old_patient_id").alias("patient_id"),
        X.full_name("old_first_name", "old_last_name").alias("patient_name"),
        F.col("old_insurance_type").alias("old_insurance"),
        F.col("new_insurance_type").alias("new_insurance"),
        F.col("new_valid_from").alias("change_date"),
        F.col("old_record_version").alias("old_version"),
        F.col("new_record_version").alias("new_version"),
    )


def address_changes(dim: DataFrame) -> DataFrame:
    """A part that is NULL on either side does not count as moved."""
    pairs = version_pairs(dim, "patient_id", ["first_name", "last_name", "address", "city", "state", "valid_from"])
    moved = reduce(lambda a, b: a | b, [F.col(f"old_{c}") != F.col(f"new_{c}") for c in ("address", "city", "state")])
    return pairs.where(moved).select(
        F.col("old_patient_id").alias("patient_id"),
        X.full_name("old_first_name", "old_last_name").alias("patient_name"),
        F.concat("old_city", F.lit(", "), "old_state").alias("old_location"),
        F.concat("new_city", F.lit(", "), "new_state").alias("new_location"),
        F.col("new_valid_from").alias("move_date"),
        (F.col("new_record_version") - F.col("old_record_version")).alias("versions_between"),
    )


def version_counts(dim: DataFrame, at_least: int = 2) -> DataFrame:
    return (
        dim.groupBy("patient_id")
        .agg(
            F.count("*").alias("version_count"),
            F.max("record_version").alias("latest_version"),
            F.min("valid_from").alias("first_seen"),
            F.max(F.when(F.col("is_current"), F.col("valid_from"))).alias("current_since"),
        )
        .where(F.col("version_count") >= at_least)
    )


# --- writing ------------------------------------------------------------------------------------


def number_rows(df: DataFrame, unique: Sequence[str], start: Column, name: str) -> DataFrame:
    """Consecutive numbers after ``start`` without sorting everything in one task.

    Rows are numbered within hash buckets of their unique columns, and each bucket is moved
    by the number of rows in the buckets before it. The offsets are BUCKETS rows, a fixed
    number, so they are broadcast. The same input gives the same numbers on every run.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in unique])
    rows = df.withColumn("_bucket", F.substring(F.md5(text), 1, 3))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    in_bucket = Window.partitionBy("_bucket").orderBy(*unique)
    return (
        rows.withColumn("_rn", F.row_number().over(in_bucket))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (start + F.col("_offset") + F.col("_rn")).cast("bigint"))
        .drop("_bucket", "_rn", "_offset")
    )


def _with_current(dim: DataFrame, source: DataFrame, key: str, eff: str) -> DataFrame:
    """Source rows, one per (key, time), beside the current version of their key."""
    attributes = [c for c in dim.columns if c != key]
    current = dim.where("is_current").select(key, *[F.col(c).alias(f"cur_{c}") for c in attributes])
    rest = [c for c in source.columns if c not in (key, eff)]
    return latest_per_key(source, [key, eff], rest).join(current, key, "left")


def _is_late(eff: str) -> Column:
    return F.coalesce(F.col(eff) <= F.col("cur_valid_from"), F.lit(False))


def late_changes(dim: DataFrame, source: DataFrame, key: str, eff: str = "effective_at") -> DataFrame:
    """Source rows whose time is not after the start of the key's current version.

    The history already covers that time: these are replays of a change that was merged, or
    changes that came late. The merge leaves them aside.
    """
    return _with_current(dim, source, key, eff).where(_is_late(eff)).select(*source.columns)


def unusable_changes(source: DataFrame, key: str, eff: str = "effective_at") -> DataFrame:
    """Source rows without a key or a time, with the ``reason``."""
    bad = source.where(F.col(key).isNull() | F.col(eff).isNull())
    return bad.withColumn("reason", F.when(F.col(key).isNull(), "no key").otherwise("no time"))


def set_aside(dim: DataFrame, source: DataFrame, key: str, eff: str = "effective_at") -> DataFrame:
    """Source rows that the merge does not apply, with the ``reason``: no key, no time, or late."""
    usable = source.where(F.col(key).isNotNull() & F.col(eff).isNotNull())
    late = late_changes(dim, usable, key, eff).withColumn("reason", F.lit("late"))
    return unusable_changes(source, key, eff).unionByName(late)


def scd2_changes(
    dim: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], eff: str = "effective_at", hot: HotKeys | None = None
) -> DataFrame:
    """Source rows that open a new version, with the version's number and validity.

    Several changes of a key in one batch apply in the order of their time; each is compared
    with the one before it, the first with the current version. Comparison is null-safe. Rows
    without a key or a time open nothing; ``set_aside`` lists them.
    """
    hot = hot_keys(source, [key]) if hot is None else hot
    usable = source.where(F.col(key).isNotNull() & F.col(eff).isNotNull())
    rows = _with_current(dim, usable, key, eff).where(~_is_late(eff))
    seq = ordered_rows(rows, [key], [eff], previous=list(tracked), running={"_seq": F.lit(1)}, hot=hot)
    known = F.col("cur_record_version").isNotNull()

    def changed_from(prefix: str) -> Column:
        return reduce(lambda a, b: a | b, [X.differs(c, f"{prefix}_{c}") for c in tracked])

    opens = F.when(F.col("_seq") > 1, changed_from("prev")).when(known, changed_from("cur")).otherwise(True)
    new = seq.where(opens).drop("_seq", *[f"prev_{c}" for c in tracked])
    out = ordered_rows(new, [key], [eff], following=[eff], running={"_k": F.lit(1)}, hot=hot)
    return (
        out.withColumn("record_version", (F.coalesce("cur_record_version", F.lit(0)) + F.col("_k")).cast("int"))
        .withColumn("valid_from", F.col(eff))
        .withColumn("valid_to", F.coalesce(f"next_{eff}", X.ts(OPEN_END)))
        .withColumn("is_current", F.col(f"next_{eff}").isNull())
        .drop("_k", f"next_{eff}")
    )


def scd2_merge(
    dim: DataFrame,
    source: DataFrame,
    key: str,
    tracked: Sequence[str],
    surrogate: str = "patient_key",
    eff: str = "effective_at",
    hot: HotKeys | None = None,
    top: Column | None = None,
) -> DataFrame:
    """The dimension with a batch of changes applied.

    New keys start at version 1, changed keys have their current row closed and a new version
    opened, unchanged rows stay. Columns that are not tracked are taken over from the current
    version, or from the source for a new key. Applying the same batch again changes nothing.
    The changes are needed three times and are staged in the shared folder. ``top`` is the largest
    surrogate key in use, if it is known; new ones follow it. Write the result to a new folder and switch readers over: one atomic step.
    """
    dim_columns = dim.columns
    changes = materialize(scd2_changes(dim, source, key, tracked, eff, hot=hot), "changes")

    closing = changes.groupBy(key).agg(F.min(eff).alias("_closed_at"))
    current = dim.where("is_current").join(closing, key, "left")
    closed = F.col("_closed_at").isNotNull()
    current = (
        current.withColumn("valid_to", F.when(closed, F.col("_closed_at")).otherwise(F.col("valid_to")))
        .withColumn("updated_at", F.when(closed, F.col("_closed_at")).otherwise(F.col("updated_at")))
        .withColumn("is_current", ~closed)
        .select(*dim_columns)
    )
    own = {key, surrogate, "valid_from", "valid_to", "is_current", "record_version"}
    known = F.col("cur_record_version").isNotNull()

    def attribute(c: str) -> Column:
        if c in own or c in tracked:
            return F.col(c)
        if c == "created_at":
            return F.col(eff).alias(c)
        if c == "updated_at":
            # A version that the same batch closes again was last touched then, as if the batch
            # had come in two parts.
            return F.when(F.col("is_current"), F.col(eff)).otherwise(F.col("valid_to")).alias(c)
        given = F.col(c) if c in source.columns else F.lit(None).cast(dim.schema[c].dataType)
        return F.when(known, F.col(f"cur_{c}")).otherwise(given).alias(c)

    top = _largest(dim, surrogate) if top is None else top
    numbered = number_rows(changes, [key, "record_version"], top, surrogate)
    opened = numbered.select(*[attribute(c) for c in dim_columns])
    return dim.where(~F.col("is_current")).unionByName(current).unionByName(opened)


def _largest(dim: DataFrame, surrogate: str) -> Column:
    return dim.agg(F.coalesce(F.max(surrogate), F.lit(0))).scalar()


def conflicting(dim: DataFrame, late: DataFrame, key: str, tracked: Sequence[str], eff: str = "effective_at") -> DataFrame:
    """Late changes for a moment at which a version of other values starts, with the ``reason``."""
    starts = dim.select(key, F.col("valid_from").alias(eff), *[F.col(c).alias(f"_own_{c}") for c in tracked])
    other = reduce(lambda a, b: a | b, [X.differs(c, f"_own_{c}") for c in tracked])
    return late.join(starts, [key, eff]).where(other).select(*late.columns).withColumn("reason", F.lit("conflict"))


def splice_late(
    dim: DataFrame,
    late: DataFrame,
    key: str,
    tracked: Sequence[str],
    surrogate: str = "patient_key",
    eff: str = "effective_at",
    hot: HotKeys | None = None,
    top: Column | None = None,
) -> DataFrame:
    """The dimension with changes that came late put into its closed history.

    A change inside a closed version, between two or before the first opens a version there, if it
    differs from what was valid just before; it is valid until the next version starts, and ends the
    version it falls into. Versions of that key are numbered anew, in order from 1; all others stay as
    they are. Existing versions keep their values and keys: a change for the very moment at which one
    starts is a replay, or a conflict that ``conflicting`` lists. Columns that are not tracked come
    from the key's current version. Splicing the same changes again changes nothing.
    """
    columns, rest = dim.columns, [c for c in late.columns if c not in (key, eff)]
    inside = latest_per_key(late, [key, eff], rest).join(dim.select(key, F.col("valid_from").alias(eff)), [key, eff], "left_anti")
    inside = materialize(_with_current(dim, inside, key, eff).where(_is_late(eff)), "late")
    touched = inside.select(key).distinct()

    def attribute(c: str) -> Column:
        given = {
            surrogate: F.lit(None), "valid_from": F.col(eff), "valid_to": F.lit(None), "is_current": F.lit(False),
            "record_version": F.lit(None), "created_at": F.col(eff), "updated_at": F.lit(None),
        }
        source = F.col(c) if c == key or c in tracked else given.get(c, F.col(f"cur_{c}") if f"cur_{c}" in inside.columns else F.lit(None))
        return source.cast(dim.schema[c].dataType).alias(c)

    events = dim.join(touched, key, "left_semi").withColumn("_new", F.lit(False)).unionByName(
        inside.select(*[attribute(c) for c in columns], F.lit(True).alias("_new"))
    )
    hot = hot_keys(inside, [key]) if hot is None else hot
    seen = ordered_rows(events, [key], ["valid_from"], previous=[*tracked, "_new"], hot=hot)
    changed = reduce(lambda a, b: a | b, [X.differs(c, f"prev_{c}") for c in tracked])
    opened = seen.where(~F.col("_new") | F.col("prev__new").isNull() | changed).select(*columns, "_new")
    placed = ordered_rows(opened, [key], ["valid_from"], following=["valid_from", "_new"], running={"_k": F.lit(1)}, hot=hot)
    cut = F.coalesce("next__new", F.lit(False)) & (F.col("valid_to") > F.col("next_valid_from"))
    ends = F.when(F.col("_new") | cut, F.col("next_valid_from"))
    own = {
        "valid_to": F.coalesce(ends, "valid_to"), "updated_at": F.coalesce(ends, "updated_at"), "record_version": F.col("_k").cast("int"),
    }
    spliced = placed.select(*[own.get(c, F.col(c)).alias(c) for c in columns], "_new")
    added = number_rows(spliced.where("_new"), [key, "record_version"], _largest(dim, surrogate) if top is None else top, surrogate)
    return (
        dim.join(touched, key, "left_anti")
        .select(*columns)
        .unionByName(spliced.where(~F.col("_new")).select(*columns))
        .unionByName(added.select(*columns))
    )


def scd2_apply(
    dim: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], surrogate: str = "patient_key", eff: str = "effective_at",
    hot: HotKeys | None = None,
) -> DataFrame:
    """The dimension with a batch of changes applied, those that came late spliced into its history first."""
    usable = source.where(F.col(key).isNotNull() & F.col(eff).isNotNull())
    late = materialize(late_changes(dim, usable, key, eff), "late-changes")
    spliced = materialize(splice_late(dim, late, key, tracked, surrogate, eff, hot), "spliced")
    return scd2_merge(spliced, source, key, tracked, surrogate, eff, hot)


def scd2_update(dim: DataFrame, key_value: str, changes: dict, at: str, key: str = "patient_id", surrogate: str = "patient_key") -> DataFrame:
    """The merge for one key: a source of one row that keeps what ``changes`` does not name.

    An unknown key leaves the dimension as it is.
    """
    types = {f.name: f.dataType for f in dim.schema}
    one = dim.where("is_current").where(F.col(key) == key_value).select(
        key, *[F.lit(v).cast(types[c]).alias(c) for c, v in changes.items()], X.ts(at).alias("effective_at")
    )
    return scd2_merge(dim, one, key, list(changes), surrogate)
