"""Batch monitoring on fixtures; streams over several files against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators.history import scd2_merge
from wardline.plans import feeds
from wardline.session import new_folder
from wardline.sources import schemas
from wardline.sources.versions import VersionStore
from wardline.streaming import jobs, monitor

D = datetime.fromisoformat
T0 = D("2025-01-01")


def requests(spark, rows):
    """Rows of (time, status, seconds)."""
    return spark.createDataFrame(
        [(i, t, "INFO", "GET", "/x", s, d) for i, (t, s, d) in enumerate(rows)],
        "request_id long, timestamp timestamp_ntz, severity string, method string, path string, status_code int, duration_seconds double")


def test_error_share_and_sustained(spark):
    """Shares of 4, 5, 6, 6 and 6 per cent, a gap, then 60."""
    rows = []
    for window, errors in [(0, 4), (1, 5), (2, 6), (3, 6), (4, 6), (9, 60)]:
        rows += [(T0 + timedelta(minutes=5 * window, seconds=i), 500 if i < errors else 200, 0.1) for i in range(100)]
    rates = monitor.error_rate(requests(spark, rows))
    got = {r.window_start.minute: (r.alert, r.level) for r in rates.collect()}
    assert got == {0: (False, "ok"), 5: (False, "ok"), 10: (True, "ok"), 15: (True, "ok"), 20: (True, "ok"), 45: (True, "critical")}
    assert [(r.window_start.minute, r.alert_windows) for r in monitor.sustained(rates, 2).orderBy("window_start").collect()] == [(15, 2), (20, 3)]


def test_latency(spark):
    rows = [(T0 + timedelta(seconds=i), 200, 0.01 * (i + 1)) for i in range(100)]
    exact = monitor.latency_p95(requests(spark, rows)).first()
    assert exact.p95_seconds == pytest.approx(0.9505) and not exact.alert
    # 75 rows are at most 0.75, 100 at most 1.0: 0.75 + 0.25 * (95 - 75) / 25
    assert monitor.latency_buckets(requests(spark, rows)).first().p95_seconds == pytest.approx(0.95)
    slow = monitor.latency_buckets(requests(spark, [(T0, 200, 99.0)])).first()
    assert slow.p95_seconds == 10.0 and slow.alert


def test_volume_anomalies(spark):
    counts = [10, 10, 10, 2, 25, 10, 10]
    rows = [(T0 + timedelta(days=i, seconds=j + 1),) for i, n in enumerate(counts) for j in range(n)]
    enc = spark.createDataFrame(rows, "admission_date timestamp_ntz")
    got = monitor.volume_anomalies(enc, "2025-01-08").where("unusual").collect()
    assert sorted(r.admissions for r in got) == [2, 25]


def test_freshness(spark):
    df = spark.createDataFrame([(T0,)], "created_at timestamp_ntz")
    assert not monitor.freshness(df, "2025-01-03").first().stale
    assert monitor.freshness(df, "2025-01-03 00:00:01").first().stale
    assert monitor.freshness(df.limit(0), "2025-01-03").first().stale


def test_log_lines_round_trip(spark, star):
    logs = monitor.parse_logs(feeds.log_lines(star.requests))
    same = star.requests.select(*logs.columns)
    assert logs.exceptAll(same).count() == 0
    assert monitor.filter_logs(logs, "ERROR", "/error", 0.5).count() == same.where(
        "severity = 'ERROR' AND path = '/error' AND duration_seconds > 0.5").count()


@pytest.fixture(scope="module")
def event_files(spark, star):
    """The events as four files, one per quarter of the ids, so that windows span batches."""
    folder = new_folder(spark, "events")
    for part in range(4):
        star.source("events").where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize(
    "job, batch, keys",
    [
        (jobs.stream_error_rate, monitor.error_rate, {}),
        (jobs.stream_error_rate, lambda r: monitor.error_rate(r, "5 minutes", "1 minute"), {"slide": "1 minute"}),
        (jobs.stream_request_rate, monitor.request_rate, {}),
        (jobs.stream_latency, monitor.latency_buckets, {}),
        (jobs.stream_sustained, lambda r: monitor.sustained(monitor.error_rate(r), 2), {"k": 2}),
    ],
)
def test_stream_equals_batch(spark, star, event_files, job, batch, keys):
    # The files hold interleaved times, so every file after the first is late by up to the whole month.
    got = job(spark, event_files, new_folder(spark, "job"), files_per_batch=1, delay="60 days", **keys)
    want = batch(star.requests)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_stream_resumes_from_its_checkpoint(spark, star):
    source, folder = new_folder(spark, "in"), new_folder(spark, "job")
    events = star.source("events")
    events.where("event_id < 300").write.parquet(source)
    jobs.stream_error_rate(spark, source, folder)
    events.where("event_id >= 300").write.mode("append").parquet(source)
    got = jobs.stream_error_rate(spark, source, folder)
    assert got.agg(F.sum("requests")).first()[0] == events.count()


def test_stream_without_input(spark, star):
    source = new_folder(spark, "none")
    star.source("events").limit(0).write.parquet(source)
    assert jobs.stream_error_rate(spark, source, new_folder(spark, "job")).count() == 0


def stored(spark, star, folder):
    store = VersionStore(spark, folder, "patient_id", feeds.TRACKED, schemas.DIM_PATIENTS, buckets=4)
    store.create(star.patients)
    return store


@pytest.mark.parametrize("splice", [True, False])
def test_stream_scd2_without_new_input_keeps_its_table(spark, star, splice):
    feed = feeds.incoming_patients(star.patients, star.physicians)
    late = feed.limit(2).withColumn("effective_at", F.lit("1990-01-01").cast("timestamp_ntz")).withColumn("city", F.lit("Elsewhere"))
    bad = feed.limit(1).withColumn("effective_at", F.lit(None).cast("timestamp_ntz"))
    nobody = feed.limit(1).withColumn("patient_id", F.lit(None).cast("string"))
    source, folder = new_folder(spark, "feed"), new_folder(spark, "dim")
    stored(spark, star, folder)
    feed.unionByName(late).unionByName(bad).unionByName(nobody).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(feed.schema).parquet(source)
        return jobs.stream_scd2(stream, folder, "patient_id", feeds.TRACKED, splice=splice)

    assert run().newest()[:2] == (1, 0)
    store = run()
    assert store.newest()[:2] == (1, 0)
    # A change for the very moment at which history starts is no version of its own.
    reason = "conflict" if splice else "late"
    assert sorted(r.reason for r in store.set_aside(feed.schema).collect()) == sorted([reason, reason, "no key", "no time"])
    want = scd2_merge(star.patients, feed, "patient_id", feeds.TRACKED).drop("patient_key")
    assert sorted(map(str, store.read().drop("patient_key").collect())) == sorted(map(str, want.collect()))


def test_stream_scd2_in_two_batches(spark, star):
    feed = feeds.incoming_patients(star.patients, star.physicians)
    source, folder = new_folder(spark, "feed"), new_folder(spark, "dim")
    stored(spark, star, folder)
    first = F.col("effective_at") == F.lit(feeds.FIRST_BATCH).cast("timestamp_ntz")

    def run():
        stream = spark.readStream.schema(feed.schema).parquet(source)
        return jobs.stream_scd2(stream, folder, "patient_id", feeds.TRACKED)

    feed.where(first).coalesce(1).write.parquet(source)
    assert run().newest()[0] == 1
    feed.where(~first).coalesce(1).write.mode("append").parquet(source)
    store = run()
    assert store.newest()[0] == 2
    want = scd2_merge(star.patients, feed, "patient_id", feeds.TRACKED).drop("patient_key")
    assert sorted(map(str, store.read().drop("patient_key").collect())) == sorted(map(str, want.collect()))


def minute_events(spark, folder, minutes, status="error"):
    """One event a minute, each in its own window of five minutes if five apart."""
    rows = [(m, T0 + timedelta(minutes=m), m, status, 1.0, None) for m in minutes]
    spark.createDataFrame(rows, schemas.SOURCE["events"]).coalesce(1).write.mode("append").parquet(folder)


def test_sustained_alerts_survive_a_restart(spark):
    source, folder = new_folder(spark, "in"), new_folder(spark, "job")

    def run():
        rows, _ = jobs.stream_sustained_runs(spark, source, folder, k=3, delay="10 minutes")
        return sorted((int((r.window_start - T0).total_seconds()) // 60, r.alert_windows) for r in rows.collect())

    minute_events(spark, source, [0, 5, 10])
    assert run() == []  # the run may go on
    minute_events(spark, source, [15])
    assert run() == []
    minute_events(spark, source, [25, 30, 60])
    assert run() == [(10, 3), (15, 4)]
    minute_events(spark, source, [65, 70, 100])
    assert run() == [(10, 3), (15, 4), (60 + 10, 3)]


def test_events_of_a_repeated_file_count_once(spark):
    source, folder = new_folder(spark, "in"), new_folder(spark, "job")
    minute_events(spark, source, range(0, 100))
    rows, dropped = jobs.stream_once(spark, source, folder, lookback="30 minutes")
    assert rows.count() == 100 and dropped == (0, 0)
    minute_events(spark, source, range(60, 130))
    rows, dropped = jobs.stream_once(spark, source, folder, lookback="30 minutes")
    assert rows.count() == 130 and dropped.replayed + dropped.late == 40
    minute_events(spark, source, [3, 99, 131])  # the first two are far behind
    rows, dropped = jobs.stream_once(spark, source, folder, lookback="30 minutes")
    assert rows.count() == 131 and dropped.late + dropped.replayed == 2 and dropped.late >= 1
