"""Staging and intermediate layers of the model graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X


def stg_patients(patients: DataFrame, as_of: str, current_only: bool = True) -> DataFrame:
    rows = patients.where("is_current") if current_only else patients
    age = X.age_years("date_of_birth", as_of)
    return rows.withColumn("age", age).select(
        "patient_key", "patient_id", "first_name", "last_name",
        X.concat_skip_null("first_name", F.lit(" "), "last_name").alias("full_name"),
        "date_of_birth", "age",
        X.buckets("age", *X.AGE_GROUPS_STAGING).alias("age_group"),
        "gender", "address", "city", "state", "zip_code", "phone_number", "insurance_type",
        X.insurance_category("insurance_type").alias("insurance_category"),
        "created_at", "updated_at", "record_version",
    )


def stg_encounters(encounters: DataFrame) -> DataFrame:
    return encounters.withColumn("length_of_stay_days", X.los_days()).select(
        "encounter_key", "patient_key", "patient_id", "department_key", "physician_key", "encounter_id",
        "admission_date", "discharge_date",
        X.day("admission_date").alias("admission_date_only"),
        X.day("discharge_date").alias("discharge_date_only"),
        "length_of_stay_days",
        X.los_category("length_of_stay_days").alias("length_of_stay_category"),
        "admission_type", "chief_complaint",
        F.lit(None).cast("string").alias("discharge_disposition"),
        X.dow("admission_date").alias("admission_day_of_week"),
        X.day_name("admission_date").alias("admission_day_name"),
        X.weekday_flag("admission_date").alias("admission_weekday_flag"),
        "created_at",
    )


def staged_visits(encounters: DataFrame, departments: DataFrame, physicians: DataFrame) -> DataFrame:
    """Encounters with department and physician: the part of the star join that keeps patients apart."""
    d = departments.select("department_key", "department_name", F.lit(None).cast("string").alias("department_type"))
    ph = physicians.select(
        "physician_key", X.full_name("first_name", "last_name").alias("physician_name"),
        F.col("specialty").alias("physician_specialty"),
    )
    return stg_encounters(encounters).drop("patient_id").join(d, "department_key").join(ph, "physician_key")


def staged_people(patients: DataFrame, as_of: str) -> DataFrame:
    """All patient versions with the names the intermediate model gives their columns."""
    return stg_patients(patients, as_of, current_only=False).select(
        "patient_key", "patient_id", F.col("full_name").alias("patient_name"), F.col("age").alias("patient_age"),
        F.col("age_group").alias("patient_age_group"), F.col("gender").alias("patient_gender"), "insurance_type",
        "insurance_category", F.col("city").alias("patient_city"), F.col("state").alias("patient_state"),
    )


def int_patient_encounters(
    patients: DataFrame, encounters: DataFrame, departments: DataFrame, physicians: DataFrame, as_of: str
) -> DataFrame:
    """Star join, one row per encounter, with the patient version the visit was made under.

    The fact carries the surrogate key of that version, so visits made under an older
    version stay in. No hints: Spark broadcasts a dimension when its size allows and
    otherwise shuffles on the key.
    """
    return (
        staged_visits(encounters, departments, physicians)
        .join(staged_people(patients, as_of), "patient_key")
        .select(
            "encounter_key", "encounter_id", "admission_date", "discharge_date", "length_of_stay_days",
            "length_of_stay_category", "admission_type", "chief_complaint", "discharge_disposition",
            "admission_day_name", "admission_weekday_flag", "patient_key", "patient_id", "patient_name",
            "patient_age", "patient_age_group", "patient_gender", "insurance_type", "insurance_category",
            "patient_city", "patient_state", "department_key", "department_name", "department_type",
            "physician_key", "physician_name", "physician_specialty",
        )
    )


def build_graph(tables: dict[str, DataFrame], as_of: str, register: bool = False) -> dict[str, DataFrame]:
    """Staging, intermediate and mart models by name, composed lazily from the star tables."""
    from wardline.plans import marts

    graph = {
        "stg_patients": stg_patients(tables["dim_patients"], as_of),
        "stg_encounters": stg_encounters(tables["fact_encounters"]),
        "int_patient_encounters": int_patient_encounters(
            tables["dim_patients"], tables["fact_encounters"], tables["dim_departments"],
            tables["dim_physicians"], as_of,
        ),
    }
    base = graph["int_patient_encounters"]
    graph["mart_encounter_summary"] = marts.mart_encounter_summary(base)
    visits = staged_visits(tables["fact_encounters"], tables["dim_departments"], tables["dim_physicians"])
    graph["mart_patient_summary"] = marts.mart_patient_summary(visits, staged_people(tables["dim_patients"], as_of), as_of)
    if register:
        for name, frame in graph.items():
            frame.createOrReplaceTempView(name)
    return graph
