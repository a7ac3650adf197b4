"""Windows over sliced hot keys give what plain windows and brute force give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators.ordered import hot_keys, mark_hot, nearest_target, ordered_rows, trailing_count
from wardline.operators.relations import chain_roots, readmitted_flag, temporal_join
from wardline.plans import clinical

START = datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def visits(spark):
    """One patient with a third of the rows, a NULL patient, ties in time, open and reversed stays."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        who = "hot" if rng.random() < 0.35 else (None if rng.random() < 0.05 else f"p{rng.randrange(40)}")
        a = START + timedelta(hours=rng.randrange(24 * 120))
        stay = rng.choice([None, -5, 0, 3, 30, 200, 900])
        d = None if stay is None else a + timedelta(hours=stay)
        rows.append((i, who, a, d, rng.choice([1, -1])))
    df = spark.createDataFrame(
        rows, "encounter_key long, patient_id string, admission_date timestamp_ntz, discharge_date timestamp_ntz, delta int"
    )
    return df.cache(), rows


HOT = [("hot",), (None,), ("p3",)]


def as_set(df):
    return sorted(map(str, df.collect()))


def test_hot_keys_are_the_largest(spark, visits):
    df, rows = visits
    assert hot_keys(df, ["patient_id"]) == []
    assert hot_keys(df, ["patient_id"], min_rows=100) == [("hot",)]
    assert len(hot_keys(df, ["patient_id"], min_rows=1, most=3)) == 3
    flagged = mark_hot(df, ["patient_id"], HOT).where("_hot").count()
    assert flagged == sum(r[1] in ("hot", None, "p3") for r in rows)


def test_sliced_windows_equal_plain_windows(visits):
    df, _ = visits
    args = dict(
        keys=["patient_id"], order=["admission_date", "encounter_key"], following=["encounter_key", "admission_date"],
        previous=["encounter_key", "discharge_date"], running={"level": F.col("delta")}, before={"prior": F.lit(1)},
        at_first={"first": F.col("delta")},
    )
    plain = ordered_rows(df, hot=[], **args)
    assert as_set(ordered_rows(df, hot=HOT, **args)) == as_set(plain)
    assert plain.count() == 900


def test_sliced_windows_by_brute_force(visits):
    df, rows = visits
    got = {r.encounter_key: r for r in ordered_rows(
        df, ["patient_id"], ["admission_date", "encounter_key"], following=["encounter_key"],
        running={"n": F.lit(1)}, hot=HOT).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    for keys in groups.values():
        for i, k in enumerate(keys):
            assert got[k].n == i + 1
            assert got[k].next_encounter_key == (keys[i + 1] if i + 1 < len(keys) else None)


@pytest.mark.parametrize("hot", [[], HOT])
def test_trailing_count(visits, hot):
    df, rows = visits
    got = {r.encounter_key: r.n for r in trailing_count(df, ["patient_id"], "admission_date", 7, "n", hot).collect()}
    for k, who, a, _, _ in rows:
        assert got[k] == sum(w == who and a - timedelta(days=7) <= t <= a for _, w, t, _, _ in rows)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("hot", [[], HOT])
def test_nearest_target(visits, hot, forward):
    df, rows = visits
    probes = df.where("discharge_date IS NOT NULL")
    found = nearest_target(
        probes, df, ["patient_id"], "discharge_date", "admission_date", ["encounter_key"], forward, hot)
    for r in found.where("is_probe").collect():
        mine = [(t, k) for k, w, t, _, _ in rows if w == r.patient_id]
        fits = [x for x in mine if (x[0] >= r.discharge_date if forward else x[0] <= r.discharge_date)]
        assert (r.hit is None) == (not fits)
        if fits:
            assert (r.hit.time, r.hit.encounter_key) == (min(fits) if forward else max(fits))


@pytest.mark.parametrize("hot", [[], HOT])
def test_readmitted_flag(visits, hot):
    df, rows = visits
    got = {r.encounter_key: r.readmitted_30d for r in readmitted_flag(df, hot=hot).collect()}
    assert len(got) == len(rows)
    for k, who, _, d, _ in rows:
        want = d is not None and who is not None and any(
            w == who and j != k and d <= t <= d + timedelta(days=30) for j, w, t, _, _ in rows
        )
        assert got[k] == int(want), k


def test_temporal_join_finds_every_version(spark):
    """Overlapping versions are all found, whatever other keys hold."""
    t = lambda y: datetime(y, 1, 1)
    versions = [("a", 1, t(1990), t(2100)), ("a", 2, t(1997), t(1998)), ("b", 1, t(2005), datetime(9999, 12, 31)), ("c", 1, t(1990), None)]
    versions += [("many", i, datetime(1999, 1, 1) + timedelta(hours=i), datetime(1999, 1, 1) + timedelta(hours=i + 1)) for i in range(1500)]
    dim = spark.createDataFrame(versions, "k string, version int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    facts = [(1, "a", t(1999)), (2, "a", datetime(1997, 6, 1)), (3, "b", t(2004)), (4, "b", t(2005)), (5, None, t(1999)), (6, "a", None),
             (7, "many", datetime(1999, 1, 2, 3, 30)), (8, "c", t(1999))]
    df = spark.createDataFrame(facts, "id int, k string, at timestamp_ntz")
    got = sorted((r.id, r.version) for r in temporal_join(df, dim, "k", "at").collect())
    assert got == [(1, 1), (2, 1), (2, 2), (4, 1), (7, 27)]
    assert temporal_join(df.limit(0), dim, "k", "at").count() == 0


def test_readmission_of_a_visit_without_admission(spark):
    rows = [(1, "p", None, datetime(2000, 1, 1)), (2, "p", datetime(2000, 1, 5), datetime(2000, 1, 6)), (3, "q", None, datetime(2000, 1, 1)),
            (4, "q", None, None)]
    df = spark.createDataFrame(rows, "encounter_key int, patient_id string, admission_date timestamp_ntz, discharge_date timestamp_ntz")
    assert sorted((r.encounter_key, r.readmitted_30d) for r in readmitted_flag(df).collect()) == [(1, 1), (2, 0), (3, 0), (4, 0)]


def test_temporal_join_is_half_open(spark, visits):
    df, rows = visits
    versions = []
    for who in ["hot", *[f"p{i}" for i in range(40)]]:
        cuts = [datetime(1990, 1, 1), START + timedelta(days=30), START + timedelta(days=45, hours=5), datetime(9999, 12, 31)]
        versions += [(who, v + 1, cuts[v], cuts[v + 1]) for v in range(3)]
    dim = spark.createDataFrame(
        versions, "patient_id string, record_version int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    edge = spark.createDataFrame(
        [(5000, "hot", START + timedelta(days=30))], "encounter_key long, patient_id string, admission_date timestamp_ntz")
    facts = df.select("encounter_key", "patient_id", "admission_date").unionByName(edge)
    got = {r.encounter_key: r.record_version for r in temporal_join(facts, dim, "patient_id", "admission_date").collect()}
    assert got[5000] == 2
    for k, who, a, _, _ in rows:
        match = [v for w, v, lo, hi in versions if w == who and lo <= a < hi]
        assert got.get(k) == (match[0] if match else None)


def test_chain_roots_of_any_depth(spark):
    """A chain of 300, a tree, a parent that is no node, and a circle."""
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(300)]
    rows += [("t", None), *[(f"t{i}", "t") for i in range(50)], *[(f"t{i}x", f"t{i}") for i in range(50)], ("o", "gone"), ("o2", "o")]
    random.Random(3).shuffle(rows)
    got = {r.node: (r.root, r.depth) for r in chain_roots(spark.createDataFrame(rows, "n string, up string"), "n", "up").collect()}
    up = dict(rows)

    def climb(n):
        depth = 0
        while up.get(n) is not None:
            n, depth = up[n], depth + 1
        return n, depth

    assert got == {n: climb(n) for n, _ in rows}
    assert chain_roots(spark.createDataFrame([], "n string, up string"), "n", "up").count() == 0
    with pytest.raises(ValueError):
        chain_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "n int, up int"), "n", "up")


@pytest.mark.parametrize("hot", [[], HOT])
def test_readmission_chains(visits, hot):
    df, rows = visits
    got = {r.encounter_key: (r.first_encounter_key, r.depth) for r in clinical.readmission_chains(df, hot=hot).collect()}
    by = {}
    for k, who, a, d, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        last = by.get(who)
        soon = last is not None and who is not None and last[1] is not None and last[1] <= a <= last[1] + timedelta(days=30)
        root, depth = (last[2], last[3] + 1) if soon else (k, 0)
        assert got[k] == (root, depth)
        by[who] = (k, d, root, depth)
    assert max(depth for _, depth in got.values()) > 2
