"""Hand-made stays: full hours, open stays, one bed used twice."""

import random
from datetime import datetime, timedelta

import pytest

from wardline.operators import occupancy
from wardline.operators.ordered import hot_keys
from wardline.sources import schemas

D = datetime.fromisoformat
DEPARTMENTS = [(1, "D1", "Medical", 4, D("2025-01-01")), (2, "D2", "Surgical", 2, D("2025-01-01"))]


def events(spark, stays):
    rows = []
    for enc, dept, bed, a, d in stays:
        rows.append((len(rows), enc, dept, bed, "bed_assigned", a, a))
        if d is not None:
            rows.append((len(rows), enc, dept, bed, "bed_discharged", d, d))
    return spark.createDataFrame(rows, schemas.FACT_BED_EVENTS)


def utilization(spark, stays):
    got = occupancy.bed_utilization(events(spark, stays), spark.createDataFrame(DEPARTMENTS, schemas.DIM_DEPARTMENTS))
    return {(r.department_name, r.slot_date, r.hour): (r.occupied_beds, r.occupancy_rate_pct) for r in got.collect()}


def test_hours_of_a_stay(spark):
    stays = [
        (1, 1, 1, D("2025-01-01T10:00"), D("2025-01-01T12:00")),  # on the hour: 10, 11
        (2, 1, 2, D("2025-01-01T10:30"), D("2025-01-01T12:30")),  # inside: 11, 12
        (3, 1, 2, D("2025-01-01T11:10"), D("2025-01-01T11:50")),  # covers no full hour
        (4, 1, 1, D("2025-01-01T09:30"), D("2025-01-01T10:30")),  # same bed as 1: 10 once
        (5, 1, 3, D("2025-01-01T11:30"), None),  # open: to the last event hour, 12
    ]
    day = D("2025-01-01").date()
    assert utilization(spark, stays) == {
        ("Medical", day, 10): (1, 25.0), ("Medical", day, 11): (2, 50.0), ("Medical", day, 12): (2, 50.0)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    stays = []
    for enc in range(120):
        a = D("2025-01-01") + timedelta(minutes=30 * rng.randrange(400))
        d = None if enc % 17 == 0 else a + timedelta(minutes=30 * rng.randrange(1, 160))
        stays.append((enc, rng.choice([1, 2]), rng.randrange(1, 5), a, d))
    got = utilization(spark, stays)
    want = {}
    for dept, name, cap in ((1, "Medical", 4), (2, "Surgical", 2)):
        mine = [s for s in stays if s[1] == dept]
        times = [t for s in mine for t in s[3:] if t]
        slot, last = min(times).replace(minute=0), max(times).replace(minute=0)
        while slot <= last:
            beds = {s[2] for s in mine if s[3] <= slot and (s[4] is None or s[4] > slot)}
            if beds:
                want[(name, slot.date(), slot.hour)] = (len(beds), float(f"{len(beds) / cap * 100:.1f}"))
            slot += timedelta(hours=1)
    assert got == want


def test_stay_pairing(spark):
    """Assigned twice on one bed, moved to another; the last discharge of the encounter ends both."""
    rows = [
        (0, 7, 1, 1, "bed_assigned", D("2025-01-01T01:00"), D("2025-01-01")),
        (1, 7, 1, 1, "bed_assigned", D("2025-01-01T02:00"), D("2025-01-01")),
        (2, 7, 1, 2, "bed_assigned", D("2025-01-01T03:00"), D("2025-01-01")),
        (3, 7, 1, 2, "bed_discharged", D("2025-01-01T05:00"), D("2025-01-01")),
        (4, None, 1, 3, "bed_assigned", D("2025-01-01T01:00"), D("2025-01-01")),
        (5, None, 1, 3, "bed_discharged", D("2025-01-01T04:00"), D("2025-01-01")),
    ]
    got = occupancy.bed_stays(spark.createDataFrame(rows, schemas.FACT_BED_EVENTS))
    assert {(r.bed_number, r.assigned_at.hour, r.discharged_at and r.discharged_at.hour) for r in got.collect()} == {
        (1, 1, 5), (2, 3, 5), (3, 1, None)}


@pytest.mark.parametrize("cut", [False, True])
def test_timeline(spark, cut):
    """First event is a discharge in bed 2; two events at one time in bed 1."""
    kinds = [(1, "bed_assigned", "01T01"), (1, "bed_discharged", "02T01"), (1, "bed_assigned", "02T01"),
             (1, "bed_assigned", "04T01"), (2, "bed_discharged", "01T05"), (2, "bed_assigned", "03T05")]
    rows = [(i, i, 1, bed, kind, D(f"2025-01-{t}:00"), D("2025-01-01")) for i, (bed, kind, t) in enumerate(kinds)]
    df = spark.createDataFrame(rows, schemas.FACT_BED_EVENTS)
    hot = hot_keys(df, occupancy.BED, min_rows=1) if cut else []
    assert len(hot) == (2 if cut else 0)
    dept = spark.createDataFrame(DEPARTMENTS, schemas.DIM_DEPARTMENTS)
    got = occupancy.bed_timeline(df, dept, hot=hot).orderBy("bed_event_key").collect()
    assert [r.occupancy_level for r in got] == [1, 0, 1, 2, 1, 2]
    assert [r.bed_status for r in got] == ["Occupied", "Available", "Occupied", "Occupied", "Occupied", "Occupied"]
    first = occupancy.first_event_per_bed(df).collect()
    assert sorted(r.bed_event_key for r in first) == [0, 4]
