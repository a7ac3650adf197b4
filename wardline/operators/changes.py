"""Change detection and incremental loading."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.sources import schemas
from wardline.sources.tables import append


def detect_changes(target: DataFrame, source: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """Source rows labelled new, updated or unchanged against the current target rows.

    NULL equals NULL. Only current versions are compared when the target keeps history.
    """
    rows = target.where("is_current") if "is_current" in target.columns else target
    known = rows.select(key, *[F.col(c).alias(f"_t_{c}") for c in compare], F.lit(True).alias("_known"))
    changed = reduce(lambda a, b: a | b, [X.differs(c, f"_t_{c}") for c in compare])
    label = F.when(F.col("_known").isNull(), "new").when(changed, "updated").otherwise("unchanged")
    return source.join(known, key, "left").withColumn("change_type", label).select(*source.columns, "change_type")


def split_changes(labelled: DataFrame) -> dict[str, DataFrame]:
    return {kind: labelled.where(F.col("change_type") == kind).drop("change_type") for kind in ("new", "updated", "unchanged")}


def last_load_timestamp(df: DataFrame, col: str = "created_at") -> DataFrame:
    """One row: the high-water mark, NULL for an empty table."""
    return df.agg(F.max(col).alias("last_load"))


def incremental_rows(
    source: DataFrame, mark, col: str = "created_at", lookback_hours: int = 0, loaded: DataFrame | None = None,
    key: str | None = None,
) -> DataFrame:
    """Rows newer than the mark, all rows for a NULL mark.

    ``mark`` is a column: a literal, which reaches the file scan, or a scalar subquery. With a
    look-back the window opens earlier and rows whose key is already loaded are left out.
    """
    bound = mark if not lookback_hours else mark - F.expr(f"interval {int(lookback_hours)} hours")
    rows = source.where(bound.isNull() | (F.col(col) > bound))
    if loaded is not None:
        if col in loaded.columns:  # what was loaded before the window cannot come again in it
            loaded = loaded.where(bound.isNull() | (F.col(col) > bound))
        rows = rows.join(loaded.select(key), key, "left_anti")
    return rows


def check_watermark(source: DataFrame, mark, col: str = "created_at") -> DataFrame:
    """One row: newest source time, mark, and whether the source is behind the mark."""
    newest = source.agg(F.max(col).alias("source_max"))
    return newest.select(
        "source_max", mark.alias("last_load"), F.coalesce(F.col("source_max") < mark, F.lit(False)).alias("went_backwards")
    )


def record_load(
    spark: SparkSession, path: str, table: str, rows: int, start: datetime, end: datetime, load_id: int,
    created_at: datetime | None = None,
) -> None:
    """Appends one row to the load history."""
    seconds = Decimal(str(round((end - start).total_seconds(), 2)))
    row = (load_id, table, rows, start, end, seconds, created_at or end)
    append(spark.createDataFrame([row], schemas.LOAD_HISTORY), path)


def load_trend(history: DataFrame) -> DataFrame:
    return history.groupBy("table_name", X.day("start_time").alias("load_date")).agg(
        F.sum("records_loaded").alias("total_records"),
        F.avg(F.col("duration_seconds").cast("double")).alias("avg_duration"),
        F.count("*").alias("load_count"),
    )


def empty_loads(history: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    recent = F.col("created_at") > X.shift(X.ts(as_of), days=-days)
    return history.where((F.col("records_loaded") == 0) & recent)


def recent_loads(history: DataFrame, n: int = 10) -> DataFrame:
    return history.orderBy(F.desc("created_at"), F.desc("load_id")).limit(n)
