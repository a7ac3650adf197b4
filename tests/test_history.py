"""Type-2 history: the merge, its invariants, change detection and incremental loading."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import changes, history, quality
from wardline.session import new_folder
from wardline.sources import schemas
from wardline.sources import versions as versions_module
from wardline.sources.versions import VersionStore

D = datetime.fromisoformat
T0, END = D("2025-01-01"), D("9999-12-31T23:59:59")
TRACKED = ["address", "city", "state", "zip_code", "insurance_type"]


def person(key, pid, address="123 Old St", city="Cambridge", insurance="Private", start=T0, end=END, current=True, version=1):
    return (key, pid, "Ann", "Lee", D("1980-02-29").date(), "F", address, city, "MA", "02139", None, insurance,
            start, end, current, version, start, start)


@pytest.fixture
def dim(spark):
    rows = [
        person(1, "p1", end=D("2025-02-01"), current=False), person(2, "p1", "5 Elm", start=D("2025-02-01"), version=2),
        person(3, "p2"), person(4, "p3"), person(5, "p4"),
    ]
    return spark.createDataFrame(rows, schemas.DIM_PATIENTS)


def source(spark, rows):
    return spark.createDataFrame(
        rows, "patient_id string, address string, city string, state string, zip_code string, insurance_type string, "
        "first_name string, last_name string, date_of_birth date, gender string, effective_at timestamp_ntz")


def change(pid, at, address="123 Old St", city="Cambridge", insurance="Private"):
    return (pid, address, city, "MA", "02139", insurance, "New", "Name", D("1990-01-01").date(), "M", D(at))


def check_invariants(dim):
    tables = {"dim_patients": dim}
    for rule in (quality.one_current_row, quality.no_history_gaps, quality.current_row_open):
        assert rule(tables, "2026-01-01").count() == 0
    assert dim.select("patient_key").distinct().count() == dim.count()


def versions(dim, pid):
    return dim.where(F.col("patient_id") == pid).orderBy("record_version").collect()


@pytest.mark.parametrize("hot", [[], [("p2",)]])
def test_merge(spark, dim, hot):
    feed = source(spark, [
        change("p1", "2025-06-15", "456 New Street", "Boston"),
        change("p2", "2025-06-15", city="Boston"), change("p2", "2025-08-01", city="Boston"),
        change("p2", "2025-07-01", city="Boston", insurance="Medicare"),
        change("p3", "2025-06-15"), change("p9", "2025-06-15", "1 Way"), change("p9", "2025-09-01", "2 Way"),
    ])
    merged = history.scd2_merge(dim, feed, "patient_id", TRACKED, hot=hot).cache()
    check_invariants(merged)
    p1 = versions(merged, "p1")
    assert [v.record_version for v in p1] == [1, 2, 3]
    assert (p1[1].valid_to, p1[1].is_current, p1[1].updated_at) == (D("2025-06-15"), False, D("2025-06-15"))
    assert (p1[2].address, p1[2].first_name, p1[2].valid_to, p1[2].is_current) == ("456 New Street", "Ann", END, True)
    # August goes back to Private, so every one of the three changes opens a version, in time order.
    assert [(v.city, v.insurance_type) for v in versions(merged, "p2")] == [
        ("Cambridge", "Private"), ("Boston", "Private"), ("Boston", "Medicare"), ("Boston", "Private")]
    assert len(versions(merged, "p3")) == 1
    p9 = versions(merged, "p9")
    assert [(v.address, v.record_version, v.valid_from) for v in p9] == [
        ("1 Way", 1, D("2025-06-15")), ("2 Way", 2, D("2025-09-01"))]
    assert p9[0].first_name == "New"
    assert merged.count() == dim.count() + 1 + 3 + 2
    again = history.scd2_merge(merged, feed, "patient_id", TRACKED)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_late_changes_are_reported_not_merged(spark, dim):
    feed = source(spark, [change("p1", "2024-12-01", "Somewhere"), change("p4", "2025-03-01", "Else")])
    assert [r.patient_id for r in history.late_changes(dim, feed, "patient_id").collect()] == ["p1"]
    assert history.scd2_merge(dim, feed, "patient_id", TRACKED).count() == dim.count() + 1


@pytest.mark.parametrize("hot", [[], [("p1",)]])
def test_late_changes_split_closed_versions(spark, dim, hot):
    feed = source(spark, [
        change("p1", "2025-01-10", "1 Late"), change("p1", "2025-01-20", "2 Late"), change("p1", "2025-01-15", "1 Late"),  # one is no change
        change("p1", "2024-06-01", "0 Early"), change("p1", "2025-01-01", "At the start"), change("p2", "2024-12-01"),
    ])
    late = history.late_changes(dim, feed, "patient_id")
    out = history.splice_late(dim, late, "patient_id", TRACKED, hot=hot).cache()
    check_invariants(out)
    p1 = versions(out, "p1")
    assert [(v.address, v.valid_from, v.valid_to, v.is_current) for v in p1] == [
        ("0 Early", D("2024-06-01"), T0, False), ("123 Old St", T0, D("2025-01-10"), False), ("1 Late", D("2025-01-10"), D("2025-01-20"), False),
        ("2 Late", D("2025-01-20"), D("2025-02-01"), False), ("5 Elm", D("2025-02-01"), END, True)]
    assert [v.record_version for v in p1] == [1, 2, 3, 4, 5] and p1[1].patient_key == 1 and p1[4].patient_key == 2
    assert (p1[1].updated_at, p1[2].created_at, p1[2].updated_at, p1[0].first_name) == (D("2025-01-10"), D("2025-01-10"), D("2025-01-20"), "Ann")
    assert [(v.valid_from, v.record_version) for v in versions(out, "p2")] == [(D("2024-12-01"), 1), (T0, 2)]
    assert out.where("patient_id IN ('p3', 'p4')").exceptAll(dim).count() == 0
    again = history.splice_late(out, history.late_changes(out, feed, "patient_id"), "patient_id", TRACKED)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert [r.address for r in history.conflicting(dim, late, "patient_id", TRACKED).collect()] == ["At the start"]


def test_apply_takes_late_and_new_changes_of_a_key(spark, dim):
    feed = source(spark, [change("p1", "2025-01-10", "1 Late"), change("p1", "2025-06-15", "9 New"), change("p7", "2025-03-01")])
    out = history.scd2_apply(dim, feed, "patient_id", TRACKED)
    check_invariants(out)
    assert [v.address for v in versions(out, "p1")] == ["123 Old St", "1 Late", "5 Elm", "9 New"]
    assert sorted(map(str, history.scd2_apply(out, feed, "patient_id", TRACKED).collect())) == sorted(map(str, out.collect()))
    assert history.scd2_apply(dim, feed.limit(0), "patient_id", TRACKED).count() == dim.count()


def keyless(rows):
    return sorted(str(r) for r in rows.drop("patient_key").collect())


def test_stored_dimension_writes_what_a_batch_touches(spark, dim):
    store = VersionStore(spark, new_folder(spark, "store"), "patient_id", TRACKED, schemas.DIM_PATIENTS, buckets=8)
    store.create(dim)
    store.create(dim.limit(0))  # there is one already
    assert keyless(store.read()) == keyless(dim)
    before = set(store.newest()[3])
    batches = [
        [change("p2", "2025-06-15", city="Boston")],
        [change("p1", "2025-01-10", "1 Late"), change("p2", "2025-07-01"), change("p9", "2025-06-15")],
        [change("p2", "2025-06-20", city="Rome"), change("p2", "2025-06-15", city="Conflict")],
    ]
    want = dim
    for n, rows in enumerate(batches):
        want = history.scd2_apply(want, source(spark, rows), "patient_id", TRACKED)
        assert store.merge(source(spark, rows), n)
        assert not store.merge(source(spark, rows), n)
        assert keyless(store.read()) == keyless(want)
        check_invariants(store.read())
        if not n:  # one bucket's current rows replaced, one closed row added, all else as it was
            now = set(store.newest()[3])
            assert len(before - now) == 1 and len(now - before) == 2
            assert spark.read.parquet(f"{store.folder}/data/commit=1").count() <= 3
    assert store.read("current").count() == want.where("is_current").count()
    assert store.read("current", source(spark, batches[0])).where("patient_id = 'p2'").count() == 1
    aside = store.set_aside(source(spark, []).schema).collect()
    assert [(r.reason, r.batch) for r in aside] == [("conflict", 2)]


def test_stored_dimension_keeps_few_pieces(spark, dim, monkeypatch):
    monkeypatch.setattr(versions_module, "COMPACT_FROM", 2)
    store = VersionStore(spark, new_folder(spark, "store"), "patient_id", TRACKED, schemas.DIM_PATIENTS, buckets=1)
    store.create(dim)
    want = dim
    for n in range(5):
        feed = source(spark, [change("p2", f"2025-0{n + 3}-01", f"{n} Way")])
        store.merge(feed, n)
        want = history.scd2_merge(want, feed, "patient_id", TRACKED)
    assert keyless(store.read()) == keyless(want)
    assert len(store.newest()[3]) <= 3


def test_update_one_key(dim):
    new = {"address": "456 New Street", "city": "Boston", "state": "MA", "zip_code": "02101"}
    got = versions(history.scd2_update(dim, "p2", new, "2025-06-15"), "p2")
    assert [(v.record_version, v.is_current, v.address) for v in got] == [(1, False, "123 Old St"), (2, True, "456 New Street")]
    assert got[1].insurance_type == "Private" and got[1].patient_key == 6
    assert history.scd2_update(dim, "p2", {"address": "123 Old St"}, "2025-06-15").count() == dim.count()
    assert history.scd2_update(dim, "unknown", new, "2025-06-15").count() == dim.count()


def test_null_safe_comparison(spark, dim):
    nulls = dim.withColumn("city", F.when(F.col("patient_id") == "p2", None).otherwise(F.col("city")))
    feed = source(spark, [change("p2", "2025-06-15"), change("p3", "2025-06-15")])
    feed = feed.withColumn("city", F.when(F.col("patient_id") == "p3", None).otherwise(F.lit(None).cast("string")))
    got = history.scd2_changes(nulls, feed, "patient_id", TRACKED).collect()
    assert [r.patient_id for r in got] == ["p3"]


def test_number_rows_is_dense_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    one = history.number_rows(df, ["k", "v"], F.lit(100), "n")
    stats = one.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(stats) == (101, 5100, 5000)
    two = history.number_rows(df.repartition(7), ["k", "v"], F.lit(100), "n")
    assert one.join(two, ["k", "n"]).count() == 5000


def test_address_change_ignores_null(spark, dim):
    assert [r.patient_id for r in history.address_changes(dim).collect()] == ["p1"]
    gone = dim.withColumn("address", F.lit(None).cast("string"))
    assert history.address_changes(gone).count() == 0


# --- change detection ---------------------------------------------------------------------------

TARGET = "patient_id string, address string, city string"


@pytest.mark.parametrize(
    "target, incoming, want",
    [
        ([], ("p1", "123 Main St", "Boston"), "new"),
        ([("p1", "123 Old St", "Cambridge")], ("p1", "123 New St", "Boston"), "updated"),
        ([("p1", "123 Main St", "Boston")], ("p1", "123 Main St", "Boston"), "unchanged"),
        ([("p1", None, "Boston")], ("p1", None, "Boston"), "unchanged"),
        ([("p1", None, "Boston")], ("p1", "x", "Boston"), "updated"),
    ],
)
def test_detect_changes(spark, target, incoming, want):
    got = changes.detect_changes(
        spark.createDataFrame(target, TARGET), spark.createDataFrame([incoming], TARGET), "patient_id", ["address", "city"])
    parts = changes.split_changes(got)
    assert {k: v.count() for k, v in parts.items()} == {k: int(k == want) for k in ("new", "updated", "unchanged")}


def test_detect_changes_empty_source_and_versions(spark, dim):
    empty = spark.createDataFrame([], TARGET)
    assert changes.detect_changes(dim, empty, "patient_id", ["address", "city"]).count() == 0
    old = spark.createDataFrame([("p1", "123 Old St", "Cambridge")], TARGET)
    assert changes.detect_changes(dim, old, "patient_id", ["address", "city"]).first().change_type == "updated"


def test_high_water_mark(spark):
    loads = spark.createDataFrame([(1, D("2025-01-15T10:30:00")), (2, D("2025-01-14"))], "k long, created_at timestamp_ntz")
    assert changes.last_load_timestamp(loads).first()[0] == D("2025-01-15T10:30:00")
    none = changes.last_load_timestamp(loads.limit(0))
    assert none.first()[0] is None
    assert changes.incremental_rows(loads, none.scalar()).count() == 2
    assert changes.incremental_rows(loads, X.ts("2025-01-14 12:00:00")).count() == 1
    back = changes.incremental_rows(loads, X.ts("2025-01-15 00:00:00"), lookback_hours=36, loaded=loads.where("k = 1"), key="k")
    assert [r.k for r in back.collect()] == [2]
    assert changes.check_watermark(loads, X.ts("2025-02-01")).first().went_backwards
    assert not changes.check_watermark(loads, none.scalar()).first().went_backwards


def test_record_load(spark):
    path = new_folder(spark, "hist")
    changes.record_load(spark, path, "t", 0, D("2025-01-01"), D("2025-01-01T00:00:02.500000"), 1)
    changes.record_load(spark, path, "t", 7, D("2025-01-01T01:00:00"), D("2025-01-01T01:00:01"), 2)
    hist = spark.read.schema(schemas.LOAD_HISTORY).parquet(path)
    assert hist.where("load_id = 1").first().duration_seconds == Decimal("2.50")
    assert changes.load_trend(hist).first()[2:] == (7, 1.75, 2)
    assert [r.load_id for r in changes.empty_loads(hist, "2025-01-05").collect()] == [1]
    assert [r.load_id for r in changes.recent_loads(hist, 1).collect()] == [2]
