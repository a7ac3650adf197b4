"""Business marts over the intermediate model, and the five dashboard views."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.quantiles import aggregate_with_quantiles


def _by_type() -> list:
    def total(kind: str, name: str):
        return F.sum(F.when(F.col("admission_type") == kind, 1).otherwise(0)).alias(name)

    return [
        total("Emergency", "emergency"),
        total("Scheduled", "scheduled"),
        total("Transfer", "transfer"),
    ]


def type_breakdown(encounters: DataFrame) -> DataFrame:
    """Visits per day split by admission type."""
    return encounters.groupBy(X.day("admission_date").alias("admission_day")).agg(*_by_type())


def mart_encounter_summary(base: DataFrame) -> DataFrame:
    """Week, month and weekday flag follow from the date and are added after grouping.

    A day is part of the key, so no group grows with the table: medians and different patients come
    from the one aggregate.
    """
    keys = ["encounter_date", "department_name", "admission_type", "patient_age_group", "insurance_category"]
    rows = base.select(
        X.day("admission_date").alias("encounter_date"), *keys[1:], "patient_key", "length_of_stay_days",
        X.los_us().alias("los_us"),
    )
    patients = F.size(F.collect_set("patient_key")).cast("bigint")
    emergency, scheduled, transfer = _by_type()
    groups = aggregate_with_quantiles(
        rows,
        keys,
        [
            F.count("*").alias("encounter_count"),
            patients.alias("unique_patients"),
            X.mean_days("los_us").alias("avg_length_of_stay"),
            F.min("length_of_stay_days").alias("min_length_of_stay"),
            F.max("length_of_stay_days").alias("max_length_of_stay"),
            emergency.alias("emergency_count"),
            scheduled.alias("scheduled_count"),
            transfer.alias("transfer_count"),
        ],
        F.col("los_us"),
        {"median_length_of_stay": 0.5},
        unit=X.US_PER_DAY,
        bounded=True,
    )
    date = F.col("encounter_date")
    return groups.select(
        date.cast("timestamp_ntz").alias("encounter_date"),
        X.trunc_ntz("week", "encounter_date").alias("encounter_week"),
        X.trunc_ntz("month", "encounter_date").alias("encounter_month"),
        X.weekday_flag("encounter_date").alias("admission_weekday_flag"),
        *[c for c in groups.columns if c != "encounter_date"],
    )


def mart_patient_summary(visits: DataFrame, people: DataFrame, as_of: str) -> DataFrame:
    """Lifetime figures per patient version with at least one visit.

    All attributes of a patient follow from the key, so visits are summed up per key before the
    attributes are joined: neither shuffle carries names for every visit.
    """
    emergency, scheduled, transfer = _by_type()
    figures = visits.withColumn("los_us", X.los_us()).groupBy("patient_key").agg(
        F.count("*").alias("total_encounters"),
        F.countDistinct("department_key").alias("departments_visited"),
        F.min("admission_date").alias("first_encounter_date"),
        F.max("admission_date").alias("last_encounter_date"),
        X.total_days("los_us").alias("total_days_hospitalized"),
        X.mean_days("los_us").alias("avg_length_of_stay"),
        F.max("length_of_stay_days").alias("max_length_of_stay"),
        emergency.alias("emergency_visits"),
        scheduled.alias("scheduled_visits"),
        transfer.alias("transfer_visits"),
        (F.count("*") >= 3).alias("is_frequent_patient"),
        (F.max("admission_date") > X.shift(X.ts(as_of), days=-30)).alias("recent_visit_30d"),
    )
    return people.join(figures, "patient_key")


# --- the five views -----------------------------------------------------------------------------


def mv_daily_hospital_snapshot(encounters: DataFrame, bed_events: DataFrame, per_department: bool = False) -> DataFrame:
    """Admissions and bed movements per day.

    As published, beds are counted by number over all departments; ``per_department`` counts
    (department, bed) instead.
    """
    bed = F.struct("department_key", "bed_number") if per_department else F.col("bed_number")
    visits = (
        encounters.withColumn("los_us", X.los_us())
        .groupBy(X.day("admission_date").alias("metric_date"))
        .agg(
            F.count("*").alias("admissions"),
            F.countDistinct("patient_key").alias("patients"),
            X.mean_days("los_us").alias("avg_los"),
            X.count_type("Emergency").alias("emergency"),
            X.count_type("Scheduled").alias("scheduled"),
        )
    )
    beds = bed_events.groupBy(X.day("event_timestamp").alias("metric_date")).agg(
        F.countDistinct(F.when(F.col("event_type") == "bed_assigned", bed)).alias("assigned"),
        F.countDistinct(F.when(F.col("event_type") == "bed_discharged", bed)).alias("released"),
    )

    def or_zero(name: str):
        return F.coalesce(name, F.lit(0))

    return visits.join(beds, "metric_date", "full").select(
        "metric_date",
        or_zero("admissions").alias("total_admissions"),
        or_zero("patients").alias("unique_patients"),
        X.round_n(or_zero("avg_los"), 2).alias("avg_length_of_stay"),
        or_zero("emergency").alias("emergency_admissions"),
        or_zero("scheduled").alias("scheduled_admissions"),
        or_zero("assigned").alias("beds_assigned"),
        or_zero("released").alias("beds_released"),
        X.pct(or_zero("emergency"), or_zero("admissions")).alias("emergency_pct"),
        X.dow("metric_date").alias("day_of_week"),
        X.weekday_flag("metric_date").alias("weekday_flag"),
    )


def mv_department_performance(
    departments: DataFrame, encounters: DataFrame, bed_events: DataFrame, physicians: DataFrame
) -> DataFrame:
    """Every fact is aggregated by department first; what is joined are one-row-per-department tables."""
    stays = encounters.select("department_key", "patient_key", "encounter_key", "admission_type", "discharge_date", X.los_us().alias("los_us"))
    visits = aggregate_with_quantiles(
        stays,
        ["department_key"],
        [
            F.count("encounter_key").alias("encounters"),
            F.countDistinct("patient_key").alias("patients"),
            X.mean_days("los_us").alias("avg_los"),
            X.count_type("Emergency").alias("emergency"),
            F.count("discharge_date").alias("discharged"),
        ],
        F.col("los_us"),
        {"median_los": 0.5},
        unit=X.US_PER_DAY,
    )
    beds = bed_events.groupBy("department_key").agg(F.countDistinct("bed_number").alias("beds"))
    return department_view(departments, visits, beds, physicians)


def department_view(departments: DataFrame, visits: DataFrame, beds: DataFrame, physicians: DataFrame) -> DataFrame:
    """The view from figures by department, one row each."""
    staff = physicians.groupBy("department_key").agg(F.count("*").alias("staff"))
    joined = (
        departments.join(visits, "department_key", "left")
        .join(beds, "department_key", "left")
        .join(staff, "department_key", "left")
        .fillna(0, ["encounters", "patients", "emergency", "discharged", "beds", "staff"])
    )
    return joined.select(
        "department_key", "department_name", "bed_capacity",
        F.col("staff").alias("physician_count"),
        F.col("encounters").alias("total_encounters"),
        F.col("patients").alias("unique_patients"),
        X.round_n("avg_los", 2).alias("avg_length_of_stay"),
        X.round_n("median_los", 2).alias("median_length_of_stay"),
        F.col("emergency").alias("emergency_count"),
        F.col("discharged").alias("discharged_count"),
        F.col("beds").alias("unique_beds_used"),
        X.pct("beds", "bed_capacity").alias("bed_utilization_pct"),
        F.round(X.ratio("encounters", "staff"), 2).alias("encounters_per_physician"),
        X.pct("emergency", "encounters").alias("emergency_pct"),
        X.pct("discharged", "encounters").alias("discharge_pct"),
    )


def mv_patient_demographics(patients: DataFrame, as_of: str) -> DataFrame:
    """Shares are taken over the aggregated table: its size is the number of combinations."""
    groups = (
        patients.where("is_current")
        .groupBy(
            X.buckets(X.age_years("date_of_birth", as_of), *X.AGE_GROUPS_LONG).alias("age_group"),
            "gender", "insurance_type", "state",
        )
        .agg(F.count("*").alias("patient_count"))
    )
    total = groups.agg(F.sum("patient_count")).scalar()
    in_group = F.sum("patient_count").over(Window.partitionBy("age_group"))
    return groups.select(
        "*",
        X.pct("patient_count", total).alias("pct_of_total_patients"),
        X.pct("patient_count", in_group).alias("pct_within_age_group"),
    )


def weekly_figures(encounters: DataFrame) -> DataFrame:
    return (
        encounters.withColumn("los_us", X.los_us())
        .groupBy(X.trunc_ntz("week", "admission_date").alias("week_start"))
        .agg(
            F.count("*").alias("weekly_admissions"),
            F.countDistinct("patient_key").alias("unique_patients"),
            X.mean_days("los_us").alias("avg_los"),
            X.count_type("Emergency").alias("emergency_admissions"),
            X.count_type("Scheduled").alias("scheduled_admissions"),
        )
    )


def mv_weekly_trends(encounters: DataFrame) -> DataFrame:
    return weekly_view(weekly_figures(encounters))


def weekly_view(weeks: DataFrame) -> DataFrame:
    """The view from figures by week. One ordered pass over one row a week is short whatever the fact holds."""
    before = F.lag("weekly_admissions").over(Window.orderBy("week_start"))
    change = F.col("weekly_admissions") - before
    return weeks.select(
        "week_start",
        X.shift("week_start", days=6).alias("week_end"),
        "weekly_admissions", "unique_patients",
        X.round_n("avg_los", 2).alias("avg_length_of_stay"),
        "emergency_admissions", "scheduled_admissions",
        X.pct("emergency_admissions", "weekly_admissions").alias("emergency_pct"),
        change.alias("wow_admissions_change"),
        X.pct(change, before).alias("wow_admissions_pct_change"),
    )


def mv_top_complaints(encounters: DataFrame, k: int = 20) -> DataFrame:
    """Complaints are free text, so ranking all of them in one window would not scale.

    The rank of a complaint depends only on those above it: take the top k first, rank those.
    """
    groups = (
        encounters.withColumn("los_us", X.los_us())
        .groupBy("chief_complaint")
        .agg(
            F.count("*").alias("encounter_count"),
            F.countDistinct("patient_key").alias("unique_patients"),
            X.round_n(X.mean_days("los_us"), 2).alias("avg_los_days"),
            X.count_type("Emergency").alias("emergency_count"),
        )
    )
    return complaint_view(groups, encounters.agg(F.count("*")).scalar(), k)


def complaint_view(groups: DataFrame, total: Column, k: int = 20) -> DataFrame:
    """The view from figures by complaint and the number of all visits."""
    top = groups.orderBy(F.desc("encounter_count"), F.col("chief_complaint").asc_nulls_last()).limit(k)
    rank = F.rank().over(Window.orderBy(F.desc("encounter_count"))).cast("bigint")
    return top.select(
        "*", X.pct("encounter_count", total).alias("pct_of_total_encounters"), rank.alias("complaint_rank")
    )


VIEWS = [
    "mv_daily_hospital_snapshot",
    "mv_department_performance",
    "mv_patient_demographics",
    "mv_weekly_trends",
    "mv_top_complaints",
]


def view_builders(tables: dict[str, DataFrame], as_of: str) -> dict:
    enc, beds = tables["fact_encounters"], tables["fact_bed_events"]
    return {
        "mv_daily_hospital_snapshot": lambda: mv_daily_hospital_snapshot(enc, beds),
        "mv_department_performance": lambda: mv_department_performance(
            tables["dim_departments"], enc, beds, tables["dim_physicians"]
        ),
        "mv_patient_demographics": lambda: mv_patient_demographics(tables["dim_patients"], as_of),
        "mv_weekly_trends": lambda: mv_weekly_trends(enc),
        "mv_top_complaints": lambda: mv_top_complaints(enc),
    }


def refresh_marts(spark, builders: dict, out: str) -> DataFrame:
    """Rebuilds each view below ``out``; one that fails is reported and does not stop the others."""
    status = []
    for name, build in builders.items():
        started = time.time()
        try:
            build().write.mode("overwrite").parquet(f"{out}/{name}")
            rows, ok, error = spark.read.parquet(f"{out}/{name}").count(), True, None
        except Exception as exc:  # noqa: BLE001 - the report is the point
            rows, ok, error = None, False, str(exc)
        status.append((name, ok, rows, float(time.time() - started), error))
    return spark.createDataFrame(status, "name string, ok boolean, rows long, seconds double, error string")


# Reads the dashboards make over a saved view.
def read_mart(mart: DataFrame, name: str, as_of: str) -> DataFrame:
    if name == "mv_daily_hospital_snapshot":
        return mart.where(F.col("metric_date") > F.date_sub(X.day_lit(as_of), 30)).orderBy("metric_date")
    if name == "mv_department_performance":
        return mart.select("department_name", "bed_utilization_pct", "total_encounters").orderBy(F.desc("bed_utilization_pct"), "department_name")
    if name == "mv_patient_demographics":
        return mart.select("age_group", "insurance_type", "patient_count").orderBy("age_group", F.desc("patient_count"), "insurance_type")
    if name == "mv_weekly_trends":
        return (
            mart.select("week_start", "weekly_admissions", "wow_admissions_pct_change")
            .orderBy(F.desc("week_start"))
            .limit(12)
        )
    if name == "mv_top_complaints":
        return (
            mart.select("complaint_rank", "chief_complaint", "encounter_count", "emergency_count")
            .orderBy("complaint_rank", "chief_complaint")
            .limit(10)
        )
    raise KeyError(name)
