"""Analytic reports: length of stay, volume, waiting times, readmissions, cohorts, workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.ordered import HotKeys, hot_keys, ordered_rows, trailing_count
from wardline.operators.quantiles import aggregate_with_quantiles
from wardline.operators.relations import chain_roots

DAY, HOUR = X.US_PER_DAY, X.US_PER_HOUR


def _stays(encounters: DataFrame, departments: DataFrame) -> DataFrame:
    names = departments.select("department_key", "department_name")
    return encounters.withColumn("los_us", X.los_us()).join(names, "department_key")


def length_of_stay(encounters: DataFrame, departments: DataFrame) -> DataFrame:
    keys = ["department_name", "admission_type"]
    rows = _stays(encounters, departments).select(*keys, "los_us")

    def of_counts(us: Column, times: Column) -> list[Column]:
        return [
            F.sum(times).alias("num_encounters"),
            X.round_n(X.weighted_mean_of_us(us, times, DAY), 2).alias("avg_los_days"),
            X.round_n(F.min(us) / F.lit(DAY), 2).alias("min_los_days"),
            X.round_n(F.max(us) / F.lit(DAY), 2).alias("max_los_days"),
        ]

    out = aggregate_with_quantiles(rows, keys, [], F.col("los_us"), {"median_los_days": 0.5}, unit=DAY, weighted=of_counts)
    return out.withColumn("median_los_days", F.round("median_los_days", 2))


def daily_volume(encounters: DataFrame, departments: DataFrame) -> DataFrame:
    """The window runs over counts: at most departments x types rows per day."""
    groups = (
        _stays(encounters, departments)
        .groupBy(X.day("admission_date").alias("admission_date"), "department_name", "admission_type")
        .agg(F.count("*").alias("num_encounters"))
    )
    total = F.sum("num_encounters").over(Window.partitionBy("admission_date"))
    return groups.withColumn("pct_of_daily_total", F.col("num_encounters") * F.lit(100.0) / total)


def er_wait_times(encounters: DataFrame, departments: DataFrame, name: str = "Emergency Department") -> DataFrame:
    keys = ["encounter_date", "encounter_hour"]
    rows = _stays(encounters, departments.where(F.col("department_name") == name)).select(
        X.day("admission_date").alias("encounter_date"), X.hour_of("admission_date").alias("encounter_hour"), "los_us"
    )
    aggregates = [
        F.count("*").alias("num_encounters"),
        X.round_n(X.mean_hours("los_us"), 2).alias("avg_wait_hours"),
        X.round_n(F.min("los_us") / F.lit(HOUR), 2).alias("min_wait_hours"),
        X.round_n(F.max("los_us") / F.lit(HOUR), 2).alias("max_wait_hours"),
    ]
    wanted = {"median_wait_hours": 0.5, "p95_wait_hours": 0.95}
    out = aggregate_with_quantiles(rows, keys, aggregates, F.col("los_us"), wanted, unit=HOUR, bounded=True)
    return out.withColumns({name: F.round(name, 2) for name in wanted})


def department_ranking(encounters: DataFrame, departments: DataFrame) -> DataFrame:
    """Ranking windows over one row per department."""
    rows = _stays(encounters, departments).select("department_name", "los_us")
    aggregates = [
        F.count("*").alias("total_encounters"),
        X.mean_days("los_us").alias("avg_los"),
        F.stddev_samp(F.col("los_us") / F.lit(DAY)).alias("stddev_los"),
    ]
    w = Window.orderBy("avg_los")
    return (
        aggregate_with_quantiles(rows, ["department_name"], aggregates, F.col("los_us"), {"median_los": 0.5}, unit=DAY)
        .withColumn("los_percentile", F.percent_rank().over(w))
        .select(
            "department_name", "total_encounters",
            X.round_n("avg_los", 2).alias("avg_length_of_stay_days"),
            X.round_n("median_los", 2).alias("median_length_of_stay_days"),
            X.round_n("stddev_los", 2).alias("stddev_length_of_stay"),
            F.rank().over(w).cast("bigint").alias("los_rank"),
            "los_percentile",
            F.ntile(4).over(Window.orderBy("avg_los", "department_name")).cast("bigint").alias("los_quartile"),
            F.when(F.col("los_percentile") < 0.25, "Top Performer")
            .when(F.col("los_percentile") < 0.75, "Average")
            .otherwise("Needs Improvement")
            .alias("performance_category"),
        )
    )


def physician_utilization(physicians: DataFrame, encounters: DataFrame, departments: DataFrame) -> DataFrame:
    """Encounters are reduced to one row per physician before the dimensions are joined.

    ``encounter_key`` is the fact's primary key and both joins are on unique keys, so its
    distinct count is its count; only patients and days need a distinct aggregate.
    """
    work = (
        encounters.withColumn("los_us", X.los_us())
        .groupBy("physician_key")
        .agg(
            F.count("encounter_key").alias("total_encounters"),
            F.countDistinct("patient_key").alias("unique_patients"),
            X.mean_days("los_us").alias("avg_los"),
            F.countDistinct(X.day("admission_date")).alias("active_days"),
        )
    )
    staff = (
        physicians.join(work, "physician_key")
        .join(departments.select("department_key", "department_name"), "department_key")
        .withColumn("physician_name", X.full_name("first_name", "last_name"))
    )
    # Rank and mean within a specialty from counts per workload: the window sees the distinct
    # workloads of a specialty, not its physicians.
    in_specialty = Window.partitionBy("specialty")
    size, n = F.sum("_c").over(in_specialty), F.col("total_encounters")
    fewer = F.sum("_c").over(in_specialty.orderBy("total_encounters").rowsBetween(Window.unboundedPreceding, -1))
    spread = (
        staff.groupBy("specialty", "total_encounters")
        .agg(F.count("*").alias("_c"))
        .select(
            "specialty", "total_encounters",
            F.when(size > 1, F.coalesce(fewer, F.lit(0)) / (size - 1)).otherwise(0.0).alias("workload_percentile_in_specialty"),
            (F.sum(F.col("_c") * n).over(in_specialty) / size).alias("_mean"),
        )
    )
    return staff.join(spread, ["specialty", "total_encounters"]).select(
        "physician_key", "physician_name", "specialty", "department_name", "total_encounters", "unique_patients",
        F.round(X.ratio("total_encounters", "unique_patients"), 2).alias("encounters_per_patient"),
        X.round_n("avg_los", 2).alias("avg_length_of_stay"), "active_days",
        F.round(X.ratio("total_encounters", "active_days"), 2).alias("encounters_per_active_day"),
        "workload_percentile_in_specialty",
        F.when(n > F.col("_mean") * 1.5, "High Utilization")
        .when(n > F.col("_mean") * 0.5, "Normal Utilization")
        .otherwise("Low Utilization")
        .alias("utilization_category"),
    )


# --- cohorts ------------------------------------------------------------------------------------


def _cohort_months(encounters: DataFrame, wrap: bool) -> DataFrame:
    """One row per patient and active month, with cohort month and month index.

    Visits are first reduced to (patient, month); the window then sees at most one row per
    month of a patient's history, so a patient with a great many visits stays small.
    """
    months = encounters.select("patient_id", X.trunc_ntz("month", "admission_date").alias("visit_month")).distinct()
    first = F.min("visit_month").over(Window.partitionBy("patient_id"))
    return months.withColumn("cohort_month", first).withColumn(
        "months_since_first", X.month_index("visit_month", "cohort_month", wrap)
    )


def cohort_retention(encounters: DataFrame, wrap: bool = False, cohorts: int = 12) -> DataFrame:
    """``wrap`` folds month indexes into 0-11 as the EXTRACT(MONTH FROM AGE) form does."""
    idx = F.col("months_since_first")

    def active(m: int):
        hit = F.when(idx == m, F.col("patient_id"))
        return F.countDistinct(hit) if wrap else F.count(hit)

    out = _cohort_months(encounters, wrap).groupBy("cohort_month").agg(
        *[active(m).alias(f"month_{m}_patients") for m in range(4)]
    )
    for m in (1, 2, 3):
        out = out.withColumn(f"month_{m}_retention_pct", X.pct(f"month_{m}_patients", "month_0_patients"))
    return out.orderBy(F.desc("cohort_month")).limit(cohorts)


def cohort_pivot(encounters: DataFrame, wrap: bool = False, cohorts: int = 12) -> DataFrame:
    """Two-level form: active patients per cohort and month, then a pivot on the month index."""
    active = (
        _cohort_months(encounters, wrap)
        .groupBy("cohort_month", "visit_month", "months_since_first")
        .agg(F.count("*").alias("active_patients"))
        .where(F.col("months_since_first") <= 3)
    )
    wide = active.groupBy("cohort_month").pivot("months_since_first", [0, 1, 2, 3]).agg(F.max("active_patients"))
    wide = wide.select("cohort_month", *[F.col(str(m)).alias(f"month_{m}") for m in range(4)])
    for m in (1, 2, 3):
        rate = F.coalesce(X.ratio(f"month_{m}", "month_0") * 100, F.lit(0.0))
        wide = wide.withColumn(f"retention_month_{m}", F.round(rate, 1))
    return wide.orderBy(F.desc("cohort_month")).limit(cohorts)


# --- windows over visits ------------------------------------------------------------------------


def readmissions(
    encounters: DataFrame, patients: DataFrame, departments: DataFrame, days: int = 30, exclude_overlap: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Visits followed by another visit of the patient within ``days`` of discharge.

    A next visit that begins before the discharge counts with a negative gap unless
    ``exclude_overlap``. Names come from the patient's current version.
    """
    visits = encounters.select("patient_id", "encounter_key", "admission_date", "discharge_date", "department_key")
    nxt = ordered_rows(
        visits, ["patient_id"], ["admission_date", "encounter_key"],
        following=["admission_date", "encounter_key", "department_key"], hot=hot,
    )
    gap = X.elapsed_us("discharge_date", "next_admission_date")
    hits = nxt.withColumn("gap_us", gap).where(F.col("gap_us") <= F.lit(days * 86_400_000_000))
    if exclude_overlap:
        hits = hits.where(F.col("gap_us") >= 0)
    who = patients.where("is_current").select("patient_id", X.full_name("first_name", "last_name").alias("patient_name"))
    where = departments.select(F.col("department_key").alias("next_department_key"), "department_name")
    return (
        hits.join(who, "patient_id")
        .join(where, "next_department_key")
        .select(
            "patient_id", "patient_name", F.col("encounter_key").alias("initial_encounter"),
            F.col("discharge_date").alias("initial_discharge"),
            F.col("next_encounter_key").alias("readmission_encounter"),
            F.col("next_admission_date").alias("readmission_date"),
            (F.col("gap_us") / F.lit(DAY)).alias("days_to_readmission"),
            "department_name",
        )
    )


def daily_counts(encounters: DataFrame) -> DataFrame:
    return encounters.groupBy(X.day("admission_date").alias("admission_day")).agg(F.count("*").alias("daily_count"))


def daily_running(encounters: DataFrame, n: int | None = 30) -> DataFrame:
    """Running total, 7-row moving average, day-over-day change; the newest ``n`` days.

    The windows have no partition key but see one row per day.
    """
    w = Window.orderBy("admission_day")
    before = F.lag("daily_count").over(w)
    change = F.col("daily_count") - before
    seven = w.rowsBetween(-6, 0)
    out = daily_counts(encounters).select(
        "admission_day", "daily_count",
        F.sum("daily_count").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_admissions"),
        (F.sum("daily_count").over(seven) / F.count("daily_count").over(seven)).alias("moving_avg_7day"),
        change.alias("day_over_day_change"),
        X.pct(change, before).alias("day_over_day_pct_change"),
    )
    return out if n is None else out.orderBy(F.desc("admission_day")).limit(n)


def centred_average(encounters: DataFrame) -> DataFrame:
    around = Window.orderBy("admission_day").rowsBetween(-3, 3)
    return daily_counts(encounters).withColumn(
        "centred_avg", F.sum("daily_count").over(around) / F.count("daily_count").over(around)
    )


def prior_visits(encounters: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Earlier visits of the patient, per encounter."""
    rows = encounters.select("patient_id", "encounter_key", "admission_date")
    return ordered_rows(
        rows, ["patient_id"], ["admission_date", "encounter_key"], before={"num_previous_visits": F.lit(1)}, hot=hot
    )


def encounter_sequence(encounters: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Row number and dense rank of the patient's visits by admission.

    The dense rank counts the visits whose time differs from the previous one's.
    """
    rows = encounters.select("patient_id", "encounter_key", "admission_date")
    order = ["admission_date", "encounter_key"]
    hot = hot_keys(rows, ["patient_id"]) if hot is None else hot
    numbered = ordered_rows(
        rows, ["patient_id"], order, previous=["admission_date"], running={"visit_number": F.lit(1)}, hot=hot
    )
    new_time = X.differs("admission_date", "prev_admission_date") | (F.col("visit_number") == 1)
    return ordered_rows(
        numbered, ["patient_id"], order, running={"visit_rank": new_time.cast("int")}, hot=hot
    ).drop("prev_admission_date")


def trailing_7d_visits(encounters: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Visits of the patient in the seven days up to each admission, that one included."""
    rows = encounters.select("patient_id", "encounter_key", "admission_date")
    return trailing_count(rows, ["patient_id"], "admission_date", 7, "visits_7d", hot=hot)


def readmission_links(encounters: DataFrame, days: int = 30, hot: HotKeys | None = None) -> DataFrame:
    """Visits with ``previous``: the patient's visit just before, if it ended within ``days`` before this one began."""
    rows = encounters.select("patient_id", "encounter_key", "admission_date", "discharge_date")
    seen = ordered_rows(
        rows, ["patient_id"], ["admission_date", "encounter_key"], previous=["encounter_key", "discharge_date"], hot=hot
    )
    out = F.col("prev_discharge_date")
    soon = (F.col("admission_date") >= out) & (F.col("admission_date") <= X.shift(out, days=days)) & F.col("patient_id").isNotNull()
    return seen.select("encounter_key", F.when(soon, F.col("prev_encounter_key")).alias("previous"))


def readmission_chains(encounters: DataFrame, days: int = 30, hot: HotKeys | None = None) -> DataFrame:
    """Per visit the first visit of its chain of readmissions and how many readmissions lie between, any number."""
    found = chain_roots(readmission_links(encounters, days, hot), "encounter_key", "previous")
    return found.select(F.col("node").alias("encounter_key"), F.col("root").alias("first_encounter_key"), "depth")


def readmission_chain_lengths(encounters: DataFrame, days: int = 30, hot: HotKeys | None = None) -> DataFrame:
    """How many chains have how many visits."""
    chains = readmission_chains(encounters, days, hot).groupBy("first_encounter_key").agg(F.count("*").alias("visits"))
    return chains.groupBy("visits").agg(F.count("*").alias("chains"))


def recursive_month_calendar(encounters: DataFrame) -> DataFrame:
    """Every month between the first and last admission, months without a visit included.

    The months of any span come from one sequence, without a loop; the fact is aggregated before it
    is joined.
    """
    month = F.trunc("admission_date", "MM").cast("date")
    visits = encounters.where(F.col("admission_date").isNotNull()).groupBy(month.alias("month_start")).agg(F.count("*").alias("n"))
    span = visits.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi")).where("lo IS NOT NULL")
    months = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month_start"))
    return months.join(visits, "month_start", "left").select("month_start", F.coalesce("n", F.lit(0)).alias("admissions"))
