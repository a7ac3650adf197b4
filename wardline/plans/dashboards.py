"""Dashboard and API queries. ``start`` is the first moment of the shown period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.ordered import HotKeys, ordered_rows
from wardline.operators.quantiles import aggregate_with_quantiles
from wardline.operators.selection import arg_max, one_row, order_by_bucket, top_k

DAY = X.US_PER_DAY


def _from(encounters: DataFrame, start: str | None) -> DataFrame:
    return encounters if start is None else encounters.where(F.col("admission_date") >= X.ts(start))


def of_department(encounters: DataFrame, departments: DataFrame, department: str) -> DataFrame:
    """Encounters of one department, found by its name."""
    key = departments.where(F.col("department_name") == department).select("department_key")
    return encounters.join(key, "department_key", "left_semi")


# --- headline numbers ---------------------------------------------------------------------------


def summary_stats(patients: DataFrame, encounters: DataFrame, departments: DataFrame, physicians: DataFrame) -> DataFrame:
    facts = encounters.withColumn("los_us", X.los_us()).agg(
        F.count("*").alias("total_encounters"), F.round(X.mean_days("los_us"), 2).alias("avg_los_days")
    )
    return one_row(
        patients.where("is_current").agg(F.count("*").alias("total_patients")),
        departments.agg(F.count("*").alias("total_departments")),
        physicians.agg(F.count("*").alias("total_physicians")),
        facts,
    )


def gauges(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    people = patients.where("is_current").agg(F.count("*").cast("double").alias("active_patients"))
    visits = encounters.withColumn("los_us", X.los_us()).agg(
        F.count("*").cast("double").alias("total_encounters"), X.mean_days("los_us").alias("avg_length_of_stay")
    )
    wide = one_row(people, visits)
    return wide.selectExpr(
        "stack(3, 'active_patients', active_patients, 'total_encounters', total_encounters, "
        "'avg_length_of_stay', avg_length_of_stay) AS (metric, value)"
    )


def home_kpis(
    patients: DataFrame, encounters: DataFrame, departments: DataFrame, bed_events: DataFrame, per_department: bool = False
) -> DataFrame:
    bed = F.struct("department_key", "bed_number") if per_department else F.col("bed_number")
    return one_row(
        patients.where("is_current").agg(F.count("*").alias("total_patients")),
        encounters.agg(F.count("*").alias("total_encounters"), F.max("created_at").alias("last_update")),
        departments.agg(F.count("*").alias("total_departments")),
        bed_events.where(F.col("event_type") == "bed_assigned").agg(F.countDistinct(bed).alias("active_beds")),
    )


def operations_kpis(
    encounters: DataFrame, bed_events: DataFrame, departments: DataFrame, start: str, per_department: bool = False
) -> DataFrame:
    bed = F.struct("department_key", "bed_number") if per_department else F.col("bed_number")
    period = _from(encounters, start).withColumn("los_us", X.los_us()).agg(
        F.count("*").alias("total_admissions"),
        F.coalesce(X.mean_days("los_us"), F.lit(0.0)).alias("avg_los"),
        F.coalesce(X.ratio(X.count_type("Emergency"), F.count("*")) * 100, F.lit(0.0)).alias("emergency_pct"),
    )
    beds = bed_events.where(F.col("event_type") == "bed_assigned").agg(F.countDistinct(bed).alias("assigned_beds"))
    capacity = departments.agg(F.sum("bed_capacity").alias("total_beds"))
    util = F.when(F.col("total_beds") > 0, X.ratio("assigned_beds", "total_beds") * 100).otherwise(0.0)
    return one_row(period, beds, capacity).withColumn("bed_util_pct", util)


# --- distributions and trends -------------------------------------------------------------------


def daily_admissions(encounters: DataFrame, start: str) -> DataFrame:
    return (
        _from(encounters, start)
        .groupBy(X.day("admission_date").alias("admission_day"))
        .agg(
            F.count("*").alias("admissions"),
            X.count_type("Emergency").alias("emergency"),
            X.count_type("Scheduled").alias("scheduled"),
        )
    )


def admission_types(
    encounters: DataFrame, departments: DataFrame | None = None, department: str | None = None, start: str | None = None
) -> DataFrame:
    rows = _from(encounters, start)
    if department is not None:
        rows = of_department(rows, departments, department)
    return rows.groupBy("admission_type").agg(F.count("*").alias("admissions"))


def los_distribution(encounters: DataFrame, start: str | None = None) -> DataFrame:
    bucket = X.buckets(X.los_days(), *X.LOS_BUCKETS).alias("los_category")
    counts = _from(encounters, start).groupBy(bucket).agg(F.count("*").alias("encounters"))
    return order_by_bucket(counts, "los_category", X.labels_of(X.LOS_BUCKETS))


def hourly_pattern(encounters: DataFrame, start: str | None = None) -> DataFrame:
    hour = X.hour_of("admission_date").alias("hour")
    return _from(encounters, start).groupBy(hour).agg(F.count("*").alias("admissions")).orderBy("hour")


def dow_pattern(encounters: DataFrame) -> DataFrame:
    return (
        encounters.groupBy(X.dow("admission_date").alias("dow"), X.day_name("admission_date").alias("day_name"))
        .agg(F.count("*").alias("admissions"))
        .orderBy("dow")
    )


def weekly_trend(encounters: DataFrame, start: str) -> DataFrame:
    """Weeks of the period that begins after ``start``."""
    return (
        encounters.where(F.col("admission_date") > X.ts(start))
        .withColumn("los_us", X.los_us())
        .groupBy(X.trunc_ntz("week", "admission_date").alias("week_start"))
        .agg(F.count("*").alias("admissions"), X.mean_days("los_us").alias("avg_los"))
    )


def los_summary(encounters: DataFrame) -> DataFrame:
    rows = encounters.select(X.los_us().alias("los_us"))
    moments = [
        X.mean_days("los_us").alias("mean_los"),
        F.round(F.stddev_samp(F.col("los_us") / F.lit(DAY)), 6).alias("stddev_los"),
        (F.min("los_us") / F.lit(DAY)).alias("min_los"),
        (F.max("los_us") / F.lit(DAY)).alias("max_los"),
    ]
    quartiles = {"q1_los": 0.25, "median_los": 0.5, "q3_los": 0.75}
    out = aggregate_with_quantiles(rows, [], moments, F.col("los_us"), quartiles, unit=DAY)
    return out.withColumn("iqr_los", F.col("q3_los") - F.col("q1_los"))


def los_histogram(encounters: DataFrame, bins: int = 50, cap: float = 30.0) -> DataFrame:
    """Counts per equal-width bin of [0, cap]; ``cap`` itself falls in the last bin.

    Mean and median of the stays up to the cap come with every row as reference lines.
    """
    rows = encounters.select(X.los_us().alias("los_us")).where(F.col("los_us") <= F.lit(cap * DAY))
    los = F.col("los_us") / F.lit(DAY)
    bin_no = F.least(F.width_bucket(los, F.lit(0.0), F.lit(float(cap)), F.lit(bins)), F.lit(bins)).cast("bigint")
    mean = rows.agg(X.mean_days("los_us").alias("mean_los")).scalar()
    median = aggregate_with_quantiles(rows, [], [], F.col("los_us"), {"median_los": 0.5}, unit=DAY).scalar()
    width = cap / bins
    return (
        rows.groupBy(bin_no.alias("bin"))
        .agg(F.count("*").alias("encounters"))
        .select(
            "bin", ((F.col("bin") - 1) * F.lit(width)).alias("bin_start"), "encounters",
            mean.alias("mean_los"), median.alias("median_los"),
        )
    )


# --- patients -----------------------------------------------------------------------------------


def patient_distribution(patients: DataFrame, col: str, n: int | None = None) -> DataFrame:
    counts = patients.where("is_current").groupBy(col).agg(F.count("*").alias("patients"))
    return counts if n is None else top_k(counts, ["-patients", col], n)


def patient_kpis(patients: DataFrame, as_of: str) -> DataFrame:
    current = patients.where("is_current")
    totals = current.agg(
        F.count("*").alias("total_patients"),
        F.avg(X.age_years("date_of_birth", as_of)).alias("avg_age"),
    )
    gender = patient_distribution(patients, "gender")
    insurance = patient_distribution(patients, "insurance_type")
    top_gender = arg_max(gender, "gender", "patients").select(
        F.col("gender").alias("most_common_gender"), F.col("patients").alias("gender_patients")
    )
    top_insurance = arg_max(insurance, "insurance_type", "patients").select(
        F.col("insurance_type").alias("most_common_insurance")
    )
    row = one_row(totals, top_gender, top_insurance)
    return row.withColumn("gender_pct", X.ratio("gender_patients", "total_patients") * 100).drop("gender_patients")


def age_distribution(patients: DataFrame, as_of: str) -> DataFrame:
    group = X.buckets(X.age_years("date_of_birth", as_of), *X.AGE_GROUPS).alias("age_group")
    counts = patients.where("is_current").groupBy(group).agg(F.count("*").alias("patients"))
    return order_by_bucket(counts, "age_group", X.labels_of(X.AGE_GROUPS))


def _visits_per_patient(encounters: DataFrame) -> DataFrame:
    """Visits are counted per patient before the dimension is joined."""
    return (
        encounters.withColumn("los_us", X.los_us())
        .groupBy("patient_id")
        .agg(F.count("encounter_key").alias("visit_count"), F.round(X.mean_days("los_us"), 1).alias("avg_los"))
    )


def frequent_patients(patients: DataFrame, encounters: DataFrame, at_least: int = 2, n: int | None = 10) -> DataFrame:
    visits = _visits_per_patient(encounters).where(F.col("visit_count") >= at_least)
    who = patients.where("is_current").select("patient_id", X.full_name("first_name", "last_name").alias("patient_name"))
    out = visits.join(who, "patient_id").select("patient_id", "patient_name", "visit_count", "avg_los")
    return out if n is None else top_k(out, ["-visit_count", "patient_id"], n)


def visit_frequency(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Includes patients without a visit."""
    visits = encounters.groupBy("patient_id").agg(F.count("encounter_key").alias("visits"))
    counts = (
        patients.where("is_current")
        .select("patient_key", "patient_id")
        .join(visits, "patient_id", "left")
        .groupBy(X.buckets(F.coalesce("visits", F.lit(0)), *X.VISIT_BUCKETS).alias("visit_category"))
        .agg(F.count("*").alias("patient_count"))
    )
    return order_by_bucket(counts, "visit_category", X.labels_of(X.VISIT_BUCKETS))


def monthly_readmissions(encounters: DataFrame, months: int | None = 12, hot: HotKeys | None = None) -> DataFrame:
    """Discharges per month and how many were followed by a visit within 30 days.

    The average rate and the total are over the months shown.
    """
    visits = encounters.select("patient_id", "encounter_key", "admission_date", "discharge_date")
    nxt = ordered_rows(
        visits, ["patient_id"], ["admission_date", "encounter_key"], following=["admission_date"], hot=hot
    )
    soon = X.elapsed_us("discharge_date", "next_admission_date") <= F.lit(30 * 86_400_000_000)
    out = (
        nxt.where(F.col("discharge_date").isNotNull())
        .groupBy(X.trunc_ntz("month", "discharge_date").alias("month"))
        .agg(F.count("*").alias("total_discharges"), X.count_where(soon).alias("readmissions_30d"))
        .withColumn("readmission_rate", X.pct("readmissions_30d", "total_discharges", 1))
    )
    if months is not None:
        out = out.orderBy(F.desc("month")).limit(months)
    shown = Window.partitionBy()
    return out.select(
        "*",
        F.round(F.avg("readmission_rate").over(shown), 4).alias("avg_rate"),
        F.sum("readmissions_30d").over(shown).alias("total_readmissions"),
    )


# --- departments --------------------------------------------------------------------------------


def _by_department(encounters: DataFrame, start: str | None) -> DataFrame:
    return (
        _from(encounters, start)
        .withColumn("los_us", X.los_us())
        .groupBy("department_key")
        .agg(
            F.count("encounter_key").alias("total_encounters"),
            F.round(X.mean_days("los_us"), 1).alias("avg_los"),
            X.count_type("Emergency").alias("emergency_count"),
            F.min("admission_date").alias("first_encounter"),
            F.max("admission_date").alias("last_encounter"),
        )
    )


def _staff(physicians: DataFrame) -> DataFrame:
    return physicians.groupBy("department_key").agg(F.count("*").alias("physician_count"))


def department_volume(departments: DataFrame, encounters: DataFrame, start: str) -> DataFrame:
    counts = _from(encounters, start).groupBy("department_key").agg(F.count("encounter_key").alias("encounters"))
    return (
        departments.join(counts, "department_key", "left")
        .groupBy("department_name")
        .agg(F.sum(F.coalesce("encounters", F.lit(0))).alias("encounters"))
    )


def department_comparison(departments: DataFrame, encounters: DataFrame, physicians: DataFrame, start: str) -> DataFrame:
    """All departments, those without visits in the period too; totals over departments in every row."""
    rows = (
        departments.join(_by_department(encounters, start), "department_key", "left")
        .join(_staff(physicians), "department_key", "left")
        .fillna(0, ["total_encounters", "emergency_count", "physician_count"])
        .select(
            "department_key", "department_name", "bed_capacity", "total_encounters", "avg_los", "emergency_count",
            X.pct("emergency_count", "total_encounters", 1).alias("emergency_pct"), "physician_count",
        )
    )
    per = F.col("total_encounters") / F.greatest("physician_count", F.lit(1))
    every = Window.partitionBy()
    return rows.select(
        "*",
        per.alias("encounters_per_physician"),
        F.sum("total_encounters").over(every).alias("all_encounters"),
        F.round(F.avg("avg_los").over(every), 4).alias("avg_los_all"),
        F.sum("bed_capacity").over(every).alias("total_capacity"),
        F.sum("physician_count").over(every).alias("total_physicians"),
    )


def department_details(departments: DataFrame, encounters: DataFrame, start: str) -> DataFrame:
    """The smaller comparison table of the operations page."""
    return (
        departments.join(_by_department(encounters, start), "department_key", "left")
        .fillna(0, ["total_encounters", "emergency_count"])
        .select(
            "department_name", "total_encounters", "avg_los", "emergency_count",
            X.pct("emergency_count", "total_encounters", 1).alias("emergency_pct"),
        )
    )


def department_detail(
    departments: DataFrame, encounters: DataFrame, physicians: DataFrame, department: str, start: str
) -> DataFrame:
    one = departments.where(F.col("department_name") == department)
    period = of_department(_from(encounters, start), departments, department)
    stays = period.select("department_key", X.los_us().alias("los_us"))
    medians = aggregate_with_quantiles(stays, ["department_key"], [], F.col("los_us"), {"median_los": 0.5}, unit=DAY)
    return (
        one.join(_by_department(period, None), "department_key", "left")
        .join(medians, "department_key", "left")
        .join(_staff(physicians), "department_key", "left")
        .fillna(0, ["total_encounters", "physician_count"])
        .select(
            "bed_capacity", "total_encounters", "avg_los", "median_los", "first_encounter", "last_encounter",
            "physician_count",
        )
    )


def department_daily(encounters: DataFrame, departments: DataFrame, department: str, start: str) -> DataFrame:
    rows = of_department(_from(encounters, start), departments, department)
    return rows.groupBy(X.day("admission_date").alias("admission_day")).agg(F.count("*").alias("admissions"))


def department_complaints(
    encounters: DataFrame, departments: DataFrame, department: str, start: str, n: int = 10
) -> DataFrame:
    rows = of_department(_from(encounters, start), departments, department)
    counts = rows.groupBy("chief_complaint").agg(F.count("*").alias("encounters"))
    return top_k(counts, ["-encounters", "chief_complaint"], n)


def los_baseline(departments: DataFrame, encounters: DataFrame) -> DataFrame:
    """Average and median stay per department with its number of encounters; departments without any are left out."""
    rows = encounters.select("department_key", "encounter_key", X.los_us().alias("los_us")).join(
        departments.select("department_key", "department_name"), "department_key"
    )
    aggregates = [X.mean_days("los_us").alias("avg_los"), F.count("encounter_key").alias("sample_size")]
    out = aggregate_with_quantiles(rows, ["department_name"], aggregates, F.col("los_us"), {"median_los": 0.5}, unit=DAY)
    return out.where(F.col("sample_size") > 0)


# --- timing queries -----------------------------------------------------------------------------


def bench_current_patients(patients: DataFrame, n: int = 100) -> DataFrame:
    return top_k(patients.where("is_current"), ["patient_key"], n)


def bench_er_count(encounters: DataFrame, departments: DataFrame) -> DataFrame:
    return of_department(encounters, departments, "Emergency Department").agg(F.count("*").alias("er_encounters"))


def bench_bed_events(bed_events: DataFrame, start: str) -> DataFrame:
    rows = bed_events.where(F.col("event_timestamp") > X.ts(start))
    return rows.groupBy("department_key").agg(F.count("*").alias("events"))
