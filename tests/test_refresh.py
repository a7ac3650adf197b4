"""Facts stored by month, and views that follow loads, against full builds."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.plans import marts, refresh
from wardline.session import new_folder
from wardline.sources import schemas
from wardline.sources.stored import Pointer, StoredFact


def stores(spark, star, names=tuple(marts.VIEWS)):
    folder = new_folder(spark, "views")
    visits = StoredFact(spark, f"{folder}/visits", schemas.FACT_ENCOUNTERS, "admission_date", "patient_id")
    beds = StoredFact(spark, f"{folder}/beds", schemas.FACT_BED_EVENTS, "event_timestamp", "encounter_key")
    return refresh.ViewStore(spark, folder, visits, beds, star.departments, star.physicians, star.patients, star.as_of, names)


def same(got, want):
    return sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_views_after_loads_equal_full_builds(spark, star, monkeypatch):
    """Interleaved loads, late rows, rows without a time, departments and complaints that come up later; pieces are put together."""
    monkeypatch.setattr(refresh, "COMPACT_FROM", 2)
    store = stores(spark, star)
    odd = star.encounters.where("encounter_key % 50 = 1").withColumns({
        "admission_date": F.lit(None).cast("timestamp_ntz"), "chief_complaint": F.lit(None).cast("string"),
        "discharge_date": F.lit(None).cast("timestamp_ntz"), "patient_key": F.lit(None).cast("bigint")})
    visits, beds = star.encounters.where("encounter_key % 50 != 1").unionByName(odd).cache(), star.bed_events
    for part in range(4):
        share = F.col("encounter_key") % 4 == part
        store.load(visits.where(share), beds.where(share))
        assert store.pointer.newest()[0] == part
    full = marts.view_builders({**star.tables, "fact_encounters": visits}, star.as_of)
    for name in marts.VIEWS:
        assert same(store.read(name), full[name]()), name
    assert max(len(paths) for paths in store.pointer.newest()[1].values()) <= 2
    empty = visits.limit(0)
    store.load(empty, beds.limit(0))
    for name in marts.VIEWS:
        assert same(store.read(name), full[name]()), name


def test_a_small_load_touches_its_days_only(spark, star):
    store = stores(spark, star, ["mv_daily_hospital_snapshot"])
    late = star.encounters.agg(F.max("admission_date")).first()[0] - timedelta(days=3)
    new = F.col("created_at") >= F.lit(late)
    store.load(star.encounters.where(~new), star.bed_events.where(~new))
    before = store.read("mv_daily_hospital_snapshot")
    rows = before.count()
    visits, beds = star.encounters.where(new), star.bed_events.where(new)
    days = {r[0] for r in visits.select(X.day("admission_date")).union(beds.select(X.day("event_timestamp"))).distinct().collect()}
    plan = store.visits.days(days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_month" in plan and len(days) < 20
    store.load(visits, beds)
    assert before.count() == rows  # what a reader has opened stays
    assert same(store.read("mv_daily_hospital_snapshot"), marts.mv_daily_hospital_snapshot(star.encounters, star.bed_events))


def test_periods_open_their_months(spark, star):
    fact = StoredFact(spark, new_folder(spark, "fact"), schemas.FACT_ENCOUNTERS, "admission_date", "patient_id")
    assert fact.read().count() == 0
    fact.load(star.encounters)
    low, high = "1996-05-10 06:00:00", "1996-07-02 00:00:00"
    got = fact.period(low, high)
    assert "PartitionFilters: [(_month" in got._jdf.queryExecution().executedPlan().toString().replace("isnotnull(_month", "(_month")
    assert got.inputFiles() and all("_month=1996" in f for f in {r[0] for r in got.select(F.input_file_name()).distinct().collect()})
    assert same(got, star.encounters.where((F.col("admission_date") >= X.ts(low)) & (F.col("admission_date") < X.ts(high))))
    assert same(fact.read(), star.encounters)


def test_readers_follow_the_newest_pointer(spark):
    pointer = Pointer(spark, new_folder(spark, "pointer"))
    assert pointer.newest() == (-1, {})
    pointer.swap(0, {"a": ["a/0"]})
    pointer.swap(1, {"a": ["a/0", "a/1"], "b": []})
    assert pointer.newest() == (1, {"a": ["a/0", "a/1"], "b": []})


@pytest.mark.parametrize("name", marts.VIEWS)
def test_empty_facts(spark, star, name):
    store = stores(spark, star, [name])
    store.load(star.encounters.limit(0), star.bed_events.limit(0))
    full = marts.view_builders({**star.tables, "fact_encounters": star.encounters.limit(0), "fact_bed_events": star.bed_events.limit(0)}, star.as_of)
    assert same(store.read(name), full[name]())
