"""Monitoring transformations. Those over request rows work on static and on streaming frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.quantiles import aggregate_with_quantiles
from wardline.plans.feeds import LOG_TIME
from wardline.sources import schemas

# --- tables -------------------------------------------------------------------------------------


def freshness(df: DataFrame, as_of: str, limit_hours: float = 48, col: str = "created_at") -> DataFrame:
    hours = X.elapsed_us("last_update", X.ts(as_of)) / F.lit(X.US_PER_HOUR)
    return (
        df.agg(F.max(col).alias("last_update"))
        .withColumn("hours_since_update", hours)
        .withColumn("stale", F.coalesce(F.col("hours_since_update") > limit_hours, F.lit(True)))
    )


def volume_anomalies(encounters: DataFrame, as_of: str, days: int = 7, low: float = 0.3, high: float = 2.0) -> DataFrame:
    """Days of the trailing period against their mean; a window over at most a few rows."""
    recent = encounters.where(F.col("admission_date") > X.shift(X.ts(as_of), days=-days))
    counts = recent.groupBy(X.day("admission_date").alias("admission_day")).agg(F.count("*").alias("admissions"))
    every = Window.partitionBy()
    mean = F.sum("admissions").over(every) / F.count("*").over(every)
    return counts.withColumn("avg_admissions", mean).withColumn(
        "unusual", (F.col("admissions") < F.col("avg_admissions") * low) | (F.col("admissions") > F.col("avg_admissions") * high)
    )


# The smallest table sizes a finished pipeline may show.
MINIMA = {"patients": 1000, "encounters": 5000}


def validate_counts(patients: DataFrame, encounters: DataFrame, minima: Mapping[str, int] = MINIMA) -> DataFrame:
    people = patients.where("is_current").agg(F.count("*").alias("n"), F.lit(None).cast("timestamp_ntz").alias("last_load"))
    visits = encounters.agg(F.count("*").alias("n"), F.max("created_at").alias("last_load"))
    rows = [
        df.select(F.lit(name).alias("check_name"), F.col("n").alias("row_count"), F.lit(minima[name]).cast("bigint").alias("minimum"), "last_load")
        for name, df in (("patients", people), ("encounters", visits))
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("row_count") >= F.col("minimum"))


# --- request log --------------------------------------------------------------------------------

# Alert limits, and the bucket bounds of request durations in seconds.
ERROR_ALERT, ERROR_WARNING, ERROR_CRITICAL = 0.05, 0.10, 0.50
LATENCY_ALERT = 1.0
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def windows(requests: DataFrame, width: str, slide: str | None, keys: Sequence[str] = ()):
    """Rows grouped by time window. The event time is cast, as a watermark needs a zoned type."""
    if not requests.isStreaming:
        requests = requests.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return requests.groupBy(F.window("timestamp", width, slide), *keys)


def with_watermark(requests: DataFrame, delay: str = "24 hours") -> DataFrame:
    """The delay equals the look-back for late data of the incremental loads."""
    return requests.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def flat_window(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        *rest,
    )


def is_error() -> Column:
    return F.col("status_code") >= 500


def error_rate(requests: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    counts = windows(requests, width, slide).agg(
        F.count("*").alias("requests"), F.sum(is_error().cast("bigint")).alias("errors")
    )
    share = F.col("errors") / F.col("requests")
    return flat_window(counts).select(
        "*",
        share.alias("error_share"),
        (share > ERROR_ALERT).alias("alert"),
        F.when(share > ERROR_CRITICAL, "critical").when(share > ERROR_WARNING, "warning").otherwise("ok").alias("level"),
    )


def request_rate(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    counts = windows(requests, width, None, ["path", "status_code"]).agg(F.count("*").alias("requests"))
    seconds = (F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))) / F.lit(1e6)
    return flat_window(counts.withColumn("per_second", F.col("requests") / seconds))


def latency_p95(requests: DataFrame, width: str = "5 minutes", limit: float = LATENCY_ALERT) -> DataFrame:
    """Exact 95th percentile per window, for static frames."""
    rows = requests.select(
        F.window(F.col("timestamp").cast("timestamp"), width).alias("window"),
        F.round(F.col("duration_seconds") * 1e6).cast("bigint").alias("us"),
    )
    rows = rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "us")
    q = aggregate_with_quantiles(rows, ["start", "end"], [], F.col("us"), {"p95_seconds": 0.95}, unit=1e6, bounded=True)
    q = q.select(F.struct("start", "end").alias("window"), "p95_seconds")
    return flat_window(q).withColumn("alert", F.col("p95_seconds") > limit)


def _below(i: int) -> Column:
    return F.sum((F.col("duration_seconds") <= DURATION_BOUNDS[i]).cast("bigint")).alias(f"le_{i}")


def histogram_quantile(q: float, cumulative: Sequence[Column], total: Column) -> Column:
    """Quantile from cumulative bucket counts, linear within a bucket; beyond the last bound, that bound."""
    rank = total * F.lit(q)
    out = F.lit(DURATION_BOUNDS[-1])
    for i in reversed(range(len(DURATION_BOUNDS))):
        lo = DURATION_BOUNDS[i - 1] if i else 0.0
        under = cumulative[i - 1] if i else F.lit(0)
        inside = (rank - under) / F.nullif(cumulative[i] - under, F.lit(0))
        out = F.when(cumulative[i] >= rank, F.lit(lo) + F.lit(DURATION_BOUNDS[i] - lo) * inside).otherwise(out)
    return out


def latency_buckets(requests: DataFrame, width: str = "5 minutes", limit: float = LATENCY_ALERT, keys: Sequence[str] = ()) -> DataFrame:
    """95th percentile from bucket counts: constant state per window, so it suits a stream."""
    counts = windows(requests, width, None, keys).agg(
        F.count("*").alias("requests"), *[_below(i) for i in range(len(DURATION_BOUNDS))]
    )
    cumulative = [F.col(f"le_{i}") for i in range(len(DURATION_BOUNDS))]
    p95 = histogram_quantile(0.95, cumulative, F.col("requests"))
    flat = flat_window(counts.withColumn("p95_seconds", p95).drop(*[f"le_{i}" for i in range(len(DURATION_BOUNDS))]))
    return flat.withColumn("alert", F.col("p95_seconds") > limit)


def sustained(alerts: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Alert windows that close a run of at least ``k`` consecutive alert windows.

    Works on per-window rows, whose number depends on the time covered and not on the traffic.
    """
    width = F.unix_micros(F.col("window_end").cast("timestamp")) - F.unix_micros(F.col("window_start").cast("timestamp"))
    slot = F.call_function("div", F.unix_micros(F.col("window_start").cast("timestamp")), width)
    by_time = Window.partitionBy(*keys).orderBy("window_start")
    run = slot - F.row_number().over(by_time)
    on = alerts.where("alert").withColumn("_run", run)
    length = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("window_start")).cast("bigint")
    return on.withColumn("alert_windows", length).where(F.col("alert_windows") >= k).select(
        *keys, "window_start", "window_end", "alert_windows"
    )


def sustained_runs(requests: DataFrame, width: str = "5 minutes", k: int = 3) -> DataFrame:
    """The rows of ``sustained`` from a stream of requests, by two stateful operators in a row.

    Windows are counted, and those with an alert are gathered in sessions that end where a window
    without one lies between. A session comes out once the watermark has passed its end, with its
    alert windows from the ``k``-th on. State holds the open windows and one row per open run.
    """
    counts = windows(requests, width, None).agg(F.count("*").alias("requests"), F.sum(is_error().cast("bigint")).alias("errors"))
    alerts = counts.where(F.col("errors") / F.col("requests") > ERROR_ALERT)
    alerts = alerts.select(F.window_time("window").alias("at"), F.col("window.start").alias("start"), F.lit("all").alias("scope"))
    # Neighbours are one width apart, and the next window but one twice as far. Sessions need a key.
    runs = alerts.groupBy("scope", F.session_window("at", f"{width} 1 second")).agg(F.count("*").alias("n"), F.min("start").alias("first"))
    step = F.expr(f"INTERVAL '{width}'")
    spread = runs.where(F.col("n") >= k).select(F.explode(F.sequence(F.lit(k).cast("bigint"), "n")).alias("alert_windows"), "first")
    start = F.col("first") + step * (F.col("alert_windows") - 1)
    return spread.select(
        start.cast("timestamp_ntz").alias("window_start"), (start + step).cast("timestamp_ntz").alias("window_end"), "alert_windows"
    )


def parse_logs(lines: DataFrame, col: str = "value") -> DataFrame:
    record = F.from_json(col, schemas.REQUEST_LOG, {"timestampNTZFormat": LOG_TIME})
    return lines.select(record.alias("r")).select("r.*")


def filter_logs(
    logs: DataFrame, severity: str | None = None, path: str | None = None, slower_than: float | None = None
) -> DataFrame:
    if severity is not None:
        logs = logs.where(F.col("severity") == severity)
    if path is not None:
        logs = logs.where(F.col("path") == path)
    if slower_than is not None:
        logs = logs.where(F.col("duration_seconds") > slower_than)
    return logs


def count_by_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("total"))


def duration_histogram(df: DataFrame, labels: Sequence[str], bounds: Sequence[float] = tuple(DURATION_BOUNDS)) -> DataFrame:
    """Cumulative counts per upper bound and label set; the last bound is infinity."""
    counts = df.groupBy(*labels).agg(
        *[F.sum((F.col("duration_seconds") <= b).cast("bigint")).alias(f"le_{i}") for i, b in enumerate(bounds)],
        F.count("duration_seconds").alias("le_inf"),
    )
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("total")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("total")))
    return counts.select(*labels, F.explode(F.array(*pairs)).alias("b")).select(*labels, "b.le", "b.total")
