"""Reports on hand-computed fixtures, and table sources and sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import selection as sel
from wardline.plans import clinical, dashboards, lookups, marts, staging
from wardline.session import new_folder
from wardline.sources import schemas, tables
from wardline.sources.reference import reference_data

D = datetime.fromisoformat
T0 = D("2025-01-01")


def encounters(spark, rows):
    """Rows of (key, patient, admission, discharge)."""
    return spark.createDataFrame(
        [(k, f"E{k}", k, p, 1, 1, a, d, "Emergency", "Fever", a) for k, p, a, d in rows], schemas.FACT_ENCOUNTERS)


@pytest.fixture
def departments(spark):
    return spark.createDataFrame([(1, "D1", "Medical", 10, T0), (2, "D2", "Surgical", 10, T0)], schemas.DIM_DEPARTMENTS)


def test_readmission_gaps(spark, departments):
    """Gaps of 29, 30 and 31 days, an overlap, an open stay."""
    a, rows, t = 0, [], T0
    for key, gap in enumerate([29, 30, 31, -1, None]):
        out = t + timedelta(days=2)
        rows.append((key, "p1", t, out if gap is not None else None))
        t = out + timedelta(days=gap or 0)
    enc = encounters(spark, rows)
    people = spark.createDataFrame([("p1", "Ann", "Lee", True)], "patient_id string, first_name string, last_name string, is_current boolean")
    got = {r.initial_encounter: r.days_to_readmission for r in clinical.readmissions(enc, people, departments).collect()}
    assert got == {0: 29.0, 1: 30.0, 3: -1.0}
    strict = clinical.readmissions(enc, people, departments, exclude_overlap=True).collect()
    assert {r.initial_encounter for r in strict} == {0, 1}


def test_cohort_month_twelve(spark):
    visits = [(0, "2024-03-15"), (1, "2024-03-31"), (2, "2024-04-01"), (3, "2024-06-02"), (4, "2025-03-01")]
    enc = encounters(spark, [(k, "p1", D(t), None) for k, t in visits])
    true = clinical.cohort_retention(enc).first()
    assert (true.month_0_patients, true.month_1_patients, true.month_2_patients, true.month_3_patients) == (1, 1, 0, 1)
    assert (true.month_1_retention_pct, true.month_2_retention_pct) == (100.0, 0.0)
    late = encounters(spark, [(0, "p1", D("2024-03-15"), None), (1, "p1", D("2025-04-01"), None)])
    assert clinical.cohort_retention(late).first().month_1_patients == 0
    assert clinical.cohort_retention(late, wrap=True).first().month_1_patients == 1
    assert clinical.cohort_pivot(enc).first().retention_month_3 == 100.0


def test_daily_running(spark):
    counts = [2, 1, 4, 0, 3, 3, 3, 8]  # the fourth day has no admission and so no row
    rows = [(i * 10 + j, f"p{j}", T0 + timedelta(days=i), None) for i, n in enumerate(counts) for j in range(n)]
    got = clinical.daily_running(encounters(spark, rows), None).orderBy("admission_day").collect()
    assert [r.daily_count for r in got] == [2, 1, 4, 3, 3, 3, 8]
    assert [r.cumulative_admissions for r in got] == [2, 3, 7, 10, 13, 16, 24]
    assert got[-1].moving_avg_7day == pytest.approx(24 / 7)
    assert [r.day_over_day_change for r in got] == [None, -1, 3, -1, 0, 0, 5]
    assert got[2].day_over_day_pct_change == 300.0


def test_open_stay_falls_in_last_class(spark):
    rows = [(0, "p", T0, None), (1, "p", T0, T0 + timedelta(days=3)), (2, "p", T0, T0 + timedelta(hours=23)), (3, "p", T0, T0 + timedelta(days=7, hours=1))]
    got = {r.encounter_key: r.length_of_stay_category for r in staging.stg_encounters(encounters(spark, rows)).collect()}
    assert got == {0: "Long (7+ days)", 1: "Medium (1-3 days)", 2: "Short (0-1 day)", 3: "Long (7+ days)"}


def test_department_without_visits_stays(spark, departments):
    enc = encounters(spark, [(0, "p", T0, T0 + timedelta(days=1))])
    staff = spark.createDataFrame([], schemas.DIM_PHYSICIANS)
    got = {r.department_name: r for r in dashboards.department_comparison(departments, enc, staff, "2024-12-01").collect()}
    assert (got["Surgical"].total_encounters, got["Surgical"].emergency_pct, got["Surgical"].avg_los) == (0, None, None)
    assert (got["Medical"].encounters_per_physician, got["Medical"].all_encounters) == (1.0, 1)
    assert dashboards.los_baseline(departments, enc).count() == 1
    volume = {r.department_name: r.encounters for r in dashboards.department_volume(departments, enc, "2024-12-01").collect()}
    assert volume == {"Medical": 1, "Surgical": 0}


def test_empty_facts(spark, departments):
    none = encounters(spark, [])
    assert dashboards.los_summary(none).first().mean_los is None
    assert dashboards.operations_kpis(none, spark.createDataFrame([], schemas.FACT_BED_EVENTS), departments, "2025-01-01").first().emergency_pct == 0.0
    assert not lookups.has_encounters(none, "p").first()[0]


def test_search_takes_wildcards_literally(spark, star):
    assert lookups.search_patients(star.patients, "%", star.as_of).count() == 0
    assert lookups.search_patients(star.patients, "ADLER", star.as_of).count() > 0


def test_null_ordering(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "k int, v int")
    assert [r.k for r in sel.order_pg(df, ["v"]).collect()] == [2, 3, 1]
    assert [r.k for r in sel.order_pg(df, ["-v"]).collect()] == [1, 3, 2]
    assert [r.k for r in sel.page(df, ["k"], 1, 1).collect()] == [2]


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([9, 8, 8, 8, 7, None])], "k int, v int")
    assert sorted((r.k, r.rank) for r in sel.top_n(df, "v", 2).collect()) == [(0, 1), (1, 2), (2, 2), (3, 2)]


def test_rounding_is_half_up(spark):
    row = spark.range(1).select(X.pct(F.lit(1), F.lit(8), 1), X.pct(F.lit(201), F.lit(200000)), X.pct(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (12.5, 0.1, None)


def test_refresh_reports_a_failing_view(spark, star):
    builders = marts.view_builders(star.tables, star.as_of)
    builders = {"mv_weekly_trends": builders["mv_weekly_trends"], "broken": lambda: star.patients.select("nothing")}
    out = new_folder(spark, "marts")
    got = {r.name: (r.ok, r.rows) for r in marts.refresh_marts(spark, builders, out).collect()}
    assert got["mv_weekly_trends"][0] and got["mv_weekly_trends"][1] > 0 and got["broken"] == (False, None)
    saved = marts.read_mart(spark.read.parquet(f"{out}/mv_weekly_trends"), "mv_weekly_trends", star.as_of)
    assert saved.count() == 12


def test_append_load_export(spark, star):
    folder = new_folder(spark, "wh")
    tables.append(star.departments, f"{folder}/dim_departments")
    tables.append(star.departments, f"{folder}/dim_departments")
    assert tables.load_table(spark, folder, "dim_departments").count() == 12
    for fmt in ("csv", "json", "parquet"):
        tables.export(star.departments, f"{folder}/{fmt}", fmt)
    assert spark.read.option("header", "true").csv(f"{folder}/csv").count() == 6
    assert reference_data(spark).count() == 6 and lookups.list_departments(star.departments).first().department_name == "Emergency Department"


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, t int")
    updates = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, t int")
    once = tables.upsert(target, updates, ["k"], latest=["t"])
    assert sorted((r.k, r.v) for r in once.collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(str, tables.upsert(once, updates, ["k"], latest=["t"]).collect())) == sorted(map(str, once.collect()))


def test_graph_views(spark, star):
    graph = staging.build_graph(star.tables, star.as_of, register=True)
    n = spark.sql("SELECT sum(encounter_count) AS n FROM mart_encounter_summary").first().n
    assert n == graph["int_patient_encounters"].count() == star.encounters.count()
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM {e} WHERE encounter_key < :k", {"k": 3}, e=star.encounters).first().n == 3


def test_filters_and_columns_reach_the_scan(star):
    plan = star.source("orders").where(F.col("o_orderdate") >= X.ts("2001-01-01")).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
