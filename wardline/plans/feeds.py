"""Incoming data derived from the star: a patient feed, a load history, score requests, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.ordered import HotKeys, ordered_rows

PATIENT_FIELDS = [
    "patient_id", "first_name", "last_name", "date_of_birth", "gender", "address", "city", "state", "zip_code",
    "phone_number", "insurance_type",
]
TRACKED = ["address", "city", "insurance_type"]
FIRST_BATCH, SECOND_BATCH = "2001-10-01 00:00:00", "2001-11-01 00:00:00"


def incoming_patients(patients: DataFrame, physicians: DataFrame) -> DataFrame:
    """Two deliveries of every current patient, and the staff as new patients in the first.

    In both, women have moved to another apartment; in the second, patients of 65 and more
    have Medicare. So a patient has no change, one, or two.
    """
    current = patients.where("is_current").select(*PATIENT_FIELDS)
    moved = F.when(F.col("gender") == "F", F.concat("address", F.lit(" Apt 2"))).otherwise(F.col("address"))
    old_enough = F.col("date_of_birth") < X.day_lit("1936-09-01")
    first = current.withColumn("address", moved).withColumn("effective_at", X.ts(FIRST_BATCH))
    second = (
        current.withColumn("address", moved)
        .withColumn("insurance_type", F.when(old_enough, "Medicare").otherwise(F.col("insurance_type")))
        .withColumn("effective_at", X.ts(SECOND_BATCH))
    )
    none = F.lit(None).cast("string")
    staff = physicians.select(
        F.col("physician_id").alias("patient_id"), "first_name", "last_name",
        F.date_add(X.day_lit("1960-01-01"), (F.col("physician_key") % 5000).cast("int")).alias("date_of_birth"),
        F.lit("Other").alias("gender"), F.lit("Staff House").alias("address"), F.lit("City 1").alias("city"),
        none.alias("state"), none.alias("zip_code"), none.alias("phone_number"),
        F.lit("Private").alias("insurance_type"), X.ts(FIRST_BATCH).alias("effective_at"),
    )
    return first.unionByName(second).unionByName(staff)


def load_history(encounters: DataFrame) -> DataFrame:
    """One load per day and table: all encounters of the day, and those still open (often none)."""
    per_day = encounters.groupBy(X.day("created_at").alias("d")).agg(
        F.count("*").alias("all_rows"), X.count_where(F.col("discharge_date").isNull()).alias("open_rows")
    )
    loads = per_day.select(
        "d",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("no"), F.lit("fact_encounters").alias("t"), F.col("all_rows").alias("n")),
                F.struct(F.lit(1).alias("no"), F.lit("open_stays").alias("t"), F.col("open_rows").alias("n")),
            )
        ).alias("x"),
    )
    start = F.col("d").cast("timestamp_ntz")
    end = F.timestamp_add("MILLISECOND", (F.col("x.n") * 250).cast("int"), start).cast("timestamp_ntz")
    return loads.select(
        (F.datediff("d", X.day_lit("1990-01-01")) * 2 + F.col("x.no")).cast("bigint").alias("load_id"),
        F.col("x.t").alias("table_name"),
        F.col("x.n").alias("records_loaded"),
        start.alias("start_time"),
        end.alias("end_time"),
        (F.col("x.n") * 0.25).cast("decimal(10,2)").alias("duration_seconds"),
        end.alias("created_at"),
    )


def score_requests(
    encounters: DataFrame, patients: DataFrame, departments: DataFrame, as_of: str, hot: HotKeys | None = None
) -> DataFrame:
    """One scoring request per closed encounter, with the fields the prediction forms ask for."""
    counted = ordered_rows(
        encounters, ["patient_id"], ["admission_date", "encounter_key"], before={"prior_visits": F.lit(1)}, hot=hot
    )
    people = patients.select("patient_key", "gender", "date_of_birth", "insurance_type")
    return (
        counted.where(F.col("discharge_date").isNotNull())
        .join(people, "patient_key")
        .join(departments.select("department_key", "department_name", "bed_capacity"), "department_key")
        .select(
            "encounter_key",
            F.greatest(X.age_years("date_of_birth", as_of), F.lit(0)).alias("age"),
            (F.col("gender") == "M").cast("int").alias("is_male"),
            (F.col("admission_type") == "Emergency").cast("int").alias("is_emergency"),
            (F.col("insurance_type") == "Uninsured").cast("int").alias("is_uninsured"),
            X.los_days().alias("los_days"),
            F.floor(X.los_days()).alias("length_of_stay"),
            F.col("prior_visits").cast("bigint").alias("prior_visits"),
            "bed_capacity", "department_name", "admission_type", "insurance_type",
            F.col("chief_complaint").isin("Chest pain", "Shortness of breath").alias("has_chronic"),
            F.pmod(X.dow("admission_date") + 6, F.lit(7)).alias("day_of_week"),
            X.hour_of("admission_date").alias("hour_of_day"),
        )
    )


LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def log_lines(requests: DataFrame) -> DataFrame:
    """The request log as JSON text, one record per line."""
    record = F.struct("timestamp", "severity", "method", "path", "status_code", "duration_seconds")
    return requests.select(F.to_json(record, {"timestampNTZFormat": LOG_TIME}).alias("value"))
