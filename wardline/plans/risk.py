"""Rule-based scores and the mapping of requests to model features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X

# Points, limits and texts of the readmission score; factors of the stay forecast.
AGE_POINTS = [(75, 25), (65, 15), (50, 5)]
VISIT_POINTS = [(5, 30), (3, 20), (1, 10)]
SHORT_STAY_POINTS, LONG_STAY_POINTS, LONG_STAY = 10, 20, 10
TYPE_POINTS = {"Emergency": 15, "Transfer": 10}
INSURANCE_POINTS = {"Self-Pay/Uninsured": 10, "Uninsured": 10, "Medicaid": 5}
CHRONIC_POINTS = 15
RISK_LEVELS = [
    (70, "HIGH RISK", "Close monitoring recommended. Consider discharge planning and follow-up within 48 hours."),
    (40, "MODERATE RISK", "Standard follow-up within 7 days. Ensure patient has clear discharge instructions."),
    (None, "LOW RISK", "Standard care. Routine follow-up as scheduled."),
]
TYPE_FACTOR = {"Emergency": 1.2, "Scheduled": 0.9}
AGE_FACTOR = {"0-17": 0.85, "55-74": 1.15, "75+": 1.15}
FORECAST_SPREAD = 0.2


def _steps(value: Column, steps: list[tuple[int, int]], strict: bool) -> Column:
    """Points of the first bound the value passes, 0 below all of them."""
    out = None
    for bound, points in steps:
        hit = value > bound if strict else value >= bound
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out.otherwise(0)


def risk_score(df: DataFrame) -> DataFrame:
    """Score 0-100 with level, recommendation and contributing factors.

    Needs ``age``, ``length_of_stay`` in whole days, ``prior_visits``, ``admission_type``,
    ``insurance_type`` and ``has_chronic``.
    """
    age, los, visits = F.col("age"), F.col("length_of_stay"), F.col("prior_visits")
    uninsured = F.col("insurance_type").isin("Self-Pay/Uninsured", "Uninsured")
    points = [
        _steps(age, AGE_POINTS, strict=True),
        F.when(los < 1, SHORT_STAY_POINTS).when(los > LONG_STAY, LONG_STAY_POINTS).otherwise(0),
        _steps(visits, VISIT_POINTS, strict=False),
        X.map_case("admission_type", TYPE_POINTS, 0),
        X.map_case("insurance_type", INSURANCE_POINTS, 0),
        F.when(F.col("has_chronic"), CHRONIC_POINTS).otherwise(0),
    ]
    score = F.least(reduce(lambda a, b: a + b, points), F.lit(100)).cast("bigint")
    level, advice = F.lit(RISK_LEVELS[-1][1]), F.lit(RISK_LEVELS[-1][2])
    for bound, name, text in reversed(RISK_LEVELS[:-1]):
        level = F.when(F.col("risk_score") >= bound, name).otherwise(level)
        advice = F.when(F.col("risk_score") >= bound, text).otherwise(advice)
    factors = F.array_compact(
        F.array(
            F.when(age > 65, F.format_string("Age %d (senior population)", age)),
            F.when(los > LONG_STAY, F.format_string("Extended LOS (%d days)", los)),
            F.when(visits >= 3, F.format_string("Frequent visitor (%d prior visits)", visits)),
            F.when(F.col("admission_type") == "Emergency", F.lit("Emergency admission")),
            F.when(uninsured, F.lit("Self-pay insurance status")),
            F.when(F.col("has_chronic"), F.lit("Chronic condition present")),
        )
    )
    return df.withColumn("risk_score", score).withColumn("risk_level", level).withColumn("recommendation", advice).withColumn(
        "factors", factors
    )


def los_forecast(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Department median times factors for admission type and age group, with a range of +-20 %.

    ``baseline`` has one row per department.
    """
    base = baseline.select("department_name", F.col("median_los").alias("base_los"), "sample_size")
    kind = X.map_case("admission_type", TYPE_FACTOR, 1.0)
    group = X.map_case("age_group", AGE_FACTOR, 1.0)
    out = df.join(base, "department_name").withColumn("predicted_los", F.col("base_los") * kind * group)
    return out.select(
        "*",
        (F.col("predicted_los") - F.col("base_los")).alias("difference"),
        (F.col("predicted_los") * (1 - FORECAST_SPREAD)).alias("lower_bound"),
        (F.col("predicted_los") * (1 + FORECAST_SPREAD)).alias("upper_bound"),
    )


# What a request leaves open.
REQUEST_DEPARTMENT = "General"
REQUEST_WEEK = "2024-01-07"


def requests_to_features(df: DataFrame, kind: str) -> DataFrame:
    """Feature rows for ``kind`` 'readmission' or 'los' from a table of score requests."""
    diagnosis = F.when(F.col("is_emergency") == 1, "Cardiac").otherwise("General").alias("diagnosis_category")
    shared = ["encounter_key", F.col("age"), F.lit(REQUEST_DEPARTMENT).alias("department_name"), diagnosis]
    if kind == "readmission":
        return df.select(
            *shared,
            F.col("los_days").alias("length_of_stay"),
            F.col("prior_visits").alias("num_previous_visits"),
            F.when(F.col("is_uninsured") == 1, "Self-Pay").otherwise("Medicare").alias("insurance_type"),
        )
    day = F.date_add(X.day_lit(REQUEST_WEEK), F.col("day_of_week").cast("int")).cast("timestamp_ntz")
    at = F.timestamp_add("HOUR", F.col("hour_of_day").cast("int"), day).cast("timestamp_ntz")
    return df.select(
        *shared, F.lit(0).cast("bigint").alias("num_previous_visits"), F.lit("Medicare").alias("insurance_type"),
        at.alias("admission_date"),
    )
