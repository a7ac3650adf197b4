"""Names of the reports and what they run on."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import selection as sel
from wardline.plans import clinical, dashboards as dash, lookups, marts, staging
from wardline.registry import AS_OF, DEPARTMENT, PATIENT, register
from wardline.sources import tables

D7, D30, D90 = lookups.since(7, AS_OF), lookups.since(30, AS_OF), lookups.since(90, AS_OF)


def _int(s):
    return staging.int_patient_encounters(s.patients, s.encounters, s.departments, s.physicians, s.as_of)


# Sources.
register("table_profile", lambda s: tables.table_profile(s.tables))
register("row_counts", lambda s: tables.row_counts(s.tables))
register("encounters_to_bed_events", lambda s: s.bed_events)
register("scan_dim_patients", lambda s: s.patients)
register("scan_dim_physicians", lambda s: s.physicians)
register("scan_fact_encounters", lambda s: s.encounters)
register(
    "run_sql_department_period",
    lambda s: tables.run_sql(
        s.spark,
        "SELECT e.encounter_key, e.admission_date FROM {enc} e JOIN {dep} d ON e.department_key = d.department_key "
        "WHERE d.department_name = :name AND e.admission_date >= CAST(:start AS TIMESTAMP_NTZ)",
        {"name": DEPARTMENT, "start": D90},
        enc=s.encounters, dep=s.departments,
    ),
)
register("upsert_latest_visit", lambda s: tables.upsert(
    s.encounters.where(F.col("admission_date") < X.ts("1998-01-01")).select("patient_id", "admission_date", "encounter_key"),
    s.encounters.where(F.col("admission_date") >= X.ts("1998-01-01")).select("patient_id", "admission_date", "encounter_key"),
    ["patient_id"], latest=["admission_date", "encounter_key"],
))
register("build_graph_visits_by_specialty", lambda s: staging.build_graph(s.tables, s.as_of)["int_patient_encounters"]
         .groupBy("physician_specialty", "insurance_category").agg(F.count("*").alias("encounters")))

# Lookups.
register("current_patients", lambda s: lookups.current_patients(s.patients))
register("patients_as_of", lambda s: lookups.patients_as_of(s.patients, "1999-06-01"))
register("patients_as_of_relation", lambda s: lookups.patients_as_of_relation(
    s.patients, s.encounters.agg(F.max("admission_date").alias("query_date"))))
register("patient_history", lambda s: lookups.patient_history(s.patients, PATIENT))
register("get_current", lambda s: lookups.get_current(s.patients, PATIENT))
register("list_patients", lambda s: lookups.list_patients(s.patients, 100, 40))
register("list_encounters", lambda s: lookups.list_encounters(s.encounters, s.departments))
register("list_encounters_of_patient", lambda s: lookups.list_encounters(s.encounters, s.departments, PATIENT))
register("search_patients", lambda s: lookups.search_patients(s.patients, "AR", s.as_of))
register("patient_encounters", lambda s: lookups.patient_encounters(s.encounters, s.departments, PATIENT))
register("trailing_90d", lambda s: lookups.trailing(s.encounters, "admission_date", 90, s.as_of).select(
    "encounter_key", "admission_date"))
register("stg_patients", lambda s: staging.stg_patients(s.patients, s.as_of))
register("stg_encounters", lambda s: staging.stg_encounters(s.encounters))
register("patient_by_first_key", lambda s: lookups.patient_by_first_key(s.patients))
register("los_values", lambda s: lookups.los_values(s.encounters, cap=30))
register("los_values_department", lambda s: lookups.los_values(s.encounters, s.departments, DEPARTMENT))
register("has_encounters", lambda s: lookups.has_encounters(s.encounters, PATIENT))
register("int_patient_encounters", _int)

# Reports.
register("length_of_stay", lambda s: clinical.length_of_stay(s.encounters, s.departments))
register("daily_volume", lambda s: clinical.daily_volume(s.encounters, s.departments))
register("er_wait_times", lambda s: clinical.er_wait_times(s.encounters, s.departments))
register("department_ranking", lambda s: clinical.department_ranking(s.encounters, s.departments))
register("physician_utilization", lambda s: clinical.physician_utilization(s.physicians, s.encounters, s.departments))
register("cohort_retention", lambda s: clinical.cohort_retention(s.encounters))
register("cohort_retention_wrapped", lambda s: clinical.cohort_retention(s.encounters, wrap=True))
register("cohort_pivot", lambda s: clinical.cohort_pivot(s.encounters))
register("mv_daily_hospital_snapshot", lambda s: marts.mv_daily_hospital_snapshot(s.encounters, s.bed_events))
register("mv_daily_hospital_snapshot_by_department",
         lambda s: marts.mv_daily_hospital_snapshot(s.encounters, s.bed_events, per_department=True))
register("mv_department_performance",
         lambda s: marts.mv_department_performance(s.departments, s.encounters, s.bed_events, s.physicians))
register("mv_patient_demographics", lambda s: marts.mv_patient_demographics(s.patients, s.as_of))
register("mv_weekly_trends", lambda s: marts.mv_weekly_trends(s.encounters))
register("mv_top_complaints", lambda s: marts.mv_top_complaints(s.encounters))
register("mart_encounter_summary", lambda s: marts.mart_encounter_summary(_int(s)))
register("mart_patient_summary", lambda s: marts.mart_patient_summary(
    staging.staged_visits(s.encounters, s.departments, s.physicians), staging.staged_people(s.patients, s.as_of), s.as_of))
register("type_breakdown", lambda s: marts.type_breakdown(s.encounters))
for _name in marts.VIEWS:
    # A read is over the saved view: its filters and columns reach that file.
    register(f"read_{_name}", lambda s, n=_name: marts.read_mart(
        tables.materialize(marts.view_builders(s.tables, s.as_of)[n](), n), n, s.as_of))
register("summary_stats", lambda s: dash.summary_stats(s.patients, s.encounters, s.departments, s.physicians))
register("gauges", lambda s: dash.gauges(s.patients, s.encounters))
register("home_kpis", lambda s: dash.home_kpis(s.patients, s.encounters, s.departments, s.bed_events))
register("operations_kpis", lambda s: dash.operations_kpis(s.encounters, s.bed_events, s.departments, D90))
register("daily_admissions", lambda s: dash.daily_admissions(s.encounters, D90))
register("admission_types", lambda s: dash.admission_types(s.encounters))
register("admission_types_department", lambda s: dash.admission_types(s.encounters, s.departments, DEPARTMENT, D90))
register("los_distribution", lambda s: dash.los_distribution(s.encounters, D90))
register("hourly_pattern", lambda s: dash.hourly_pattern(s.encounters))
register("hourly_pattern_period", lambda s: dash.hourly_pattern(s.encounters, D90))
register("dow_pattern", lambda s: dash.dow_pattern(s.encounters))
register("weekly_trend", lambda s: dash.weekly_trend(s.encounters, D90))
register("los_summary", lambda s: dash.los_summary(s.encounters))
register("los_histogram", lambda s: dash.los_histogram(s.encounters))
register("los_histogram_department",
         lambda s: dash.los_histogram(dash.of_department(s.encounters, s.departments, DEPARTMENT), bins=30))
register("patient_distribution_gender", lambda s: dash.patient_distribution(s.patients, "gender"))
register("patient_distribution_insurance", lambda s: dash.patient_distribution(s.patients, "insurance_type"))
register("patient_distribution_state", lambda s: dash.patient_distribution(s.patients, "state", 10))
register("patient_kpis", lambda s: dash.patient_kpis(s.patients, s.as_of))
register("age_distribution", lambda s: dash.age_distribution(s.patients, s.as_of))
register("department_volume", lambda s: dash.department_volume(s.departments, s.encounters, D30))
register("department_comparison",
         lambda s: dash.department_comparison(s.departments, s.encounters, s.physicians, D90))
register("department_details", lambda s: dash.department_details(s.departments, s.encounters, D90))
register("department_detail",
         lambda s: dash.department_detail(s.departments, s.encounters, s.physicians, DEPARTMENT, D90))
register("department_daily", lambda s: dash.department_daily(s.encounters, s.departments, DEPARTMENT, D90))
register("department_complaints", lambda s: dash.department_complaints(s.encounters, s.departments, DEPARTMENT, D90))
register("frequent_patients", lambda s: dash.frequent_patients(s.patients, s.encounters))
register("visit_frequency", lambda s: dash.visit_frequency(s.patients, s.encounters))
register("monthly_readmissions", lambda s: dash.monthly_readmissions(s.encounters))
register("los_baseline", lambda s: dash.los_baseline(s.departments, s.encounters))
register("bench_current_patients", lambda s: dash.bench_current_patients(s.patients))
register("bench_er_count", lambda s: dash.bench_er_count(s.encounters, s.departments))
register("bench_bed_events", lambda s: dash.bench_bed_events(s.bed_events, D7))

# Windows.
register("readmissions", lambda s: clinical.readmissions(s.encounters, s.patients, s.departments))
register("readmissions_without_overlap",
         lambda s: clinical.readmissions(s.encounters, s.patients, s.departments, exclude_overlap=True))
register("daily_running", lambda s: clinical.daily_running(s.encounters))
register("daily_running_all", lambda s: clinical.daily_running(s.encounters, None))
register("centred_average", lambda s: clinical.centred_average(s.encounters))
register("prior_visits", lambda s: clinical.prior_visits(s.encounters))
register("encounter_sequence", lambda s: clinical.encounter_sequence(s.encounters))
register("trailing_7d_visits", lambda s: clinical.trailing_7d_visits(s.encounters))
register("recursive_month_calendar", lambda s: clinical.recursive_month_calendar(s.encounters))

# Sorting, top-k, set operations.
register("order_pg_open_stays", lambda s: sel.order_pg(
    s.encounters.select("encounter_key", "discharge_date"), ["-discharge_date", "encounter_key"]))
register("order_by_bucket_los", lambda s: sel.order_by_bucket(
    staging.stg_encounters(s.encounters).groupBy("length_of_stay_category").agg(F.count("*").alias("encounters")),
    "length_of_stay_category",
    ["Short (0-1 day)", "Medium (1-3 days)", "Extended (3-7 days)", "Long (7+ days)"]))
register("top_k_longest_stays", lambda s: sel.top_k(
    s.encounters.select("encounter_key", X.los_us().alias("los_us")).where(F.col("los_us").isNotNull()),
    ["-los_us", "encounter_key"], 25))
register("page_encounters", lambda s: sel.page(
    s.encounters.select("encounter_key", "admission_date"), ["admission_date", "encounter_key"], 50, 200))
register("arg_max_state", lambda s: sel.arg_max(dash.patient_distribution(s.patients, "state"), "state", "patients"))
register("top_n_days_by_admissions", lambda s: sel.top_n(clinical.daily_counts(s.encounters), "daily_count", 5))
register("top_n_days_per_type", lambda s: sel.top_n(
    s.encounters.groupBy("admission_type", X.day("admission_date").alias("admission_day")).agg(F.count("*").alias("visits")),
    "visits", 2, ["admission_type"]))
register("union_all_movements", lambda s: sel.union_all(
    s.encounters.select("encounter_key", F.col("admission_date").alias("at"), F.lit("in").alias("direction")),
    s.encounters.where(F.col("discharge_date").isNotNull()).select(
        "encounter_key", F.col("discharge_date").alias("at"), F.lit("out").alias("direction"))))

# Scalar expressions that no report shows on their own.
register("scalar_time", lambda s: s.encounters.select(
    "encounter_key", X.trunc_ntz("hour", "admission_date").alias("hour_slot"), X.hour_or("discharge_date").alias("discharge_hour"),
    X.month_index("admission_date", X.ts("1995-01-01")).alias("months"),
    X.month_index("admission_date", X.ts("1995-01-01"), wrap=True).alias("months_wrapped"),
    X.shift("admission_date", days=6, hours=-3).alias("shifted"), X.los_hours().alias("hours")))
register("scalar_numbers", lambda s: s.source("events").select(
    "event_id", X.clip("value", 0.0, 60.0).alias("clipped"), X.round_n("value", 1).alias("rounded"),
    X.ratio("value", F.col("user_id") % 3).alias("ratio"), X.json_field("props", "k").cast("bigint").alias("k")))
register("scalar_text", lambda s: s.patients.select(
    "patient_key", X.full_name("first_name", "last_name").alias("name"),
    X.concat_skip_null("city", F.lit("/"), F.when(F.col("record_version") > 1, F.col("state"))).alias("place"),
    X.full_name("city", F.when(F.col("record_version") > 1, F.col("state"))).alias("place_or_null"),
    X.age_years("date_of_birth", s.as_of).alias("age"), X.insurance_category("insurance_type").alias("category"),
    X.differs("state", F.when(F.col("record_version") > 1, F.col("state"))).alias("state_differs")))
