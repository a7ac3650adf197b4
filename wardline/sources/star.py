"""The hospital star derived from the driver's tables.

Customers become patients with one to three versions, suppliers physicians, orders
encounters, and encounters two bed events each. Every column is an expression on the
source row, so the derivation itself needs no shuffle; the only joins are to the nation
table and to the six departments.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.session import prepare
from wardline.sources import schemas
from wardline.sources.reference import COMPLAINTS, DEPARTMENTS, reference_data

OPEN_END = "9999-12-31 23:59:59"
AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"
EPOCH = "1990-01-01 00:00:00"

FIRST_NAMES = ["Anna", "Ben", "Carla", "David", "Elena", "Farid", "Grace", "Hugo", "Ines", "Jonas"]
LAST_NAMES = ["Adler", "Brooks", "Costa", "Dietz", "Evans", "Fischer", "Garcia"]
INSURANCE_BY_SEGMENT = {
    "AUTOMOBILE": "Private",
    "BUILDING": "Uninsured",
    "FURNITURE": "Private",
    "HOUSEHOLD": "Medicare",
    "MACHINERY": "Medicaid",
}


def _list(values: list[str]) -> str:
    return "array(" + ", ".join(repr(v) for v in values) + ")"


def _digits(number: str, width: int) -> str:
    """Number as text, padded with zeros to at least ``width`` digits."""
    return f"lpad({number}, greatest(length({number}), {width}), '0')"


# SQL expressions over a source row, as texts: a whole table is one call to the JVM.
_SECOND_FROM = "date_add(date'1997-01-01', cast({k} % 365 AS int))"  # the third version starts three years later
_VERSIONS = "CASE WHEN c_custkey % 25 = 0 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END"
_BASE_INSURANCE = "CASE c_mktsegment " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in INSURANCE_BY_SEGMENT.items()
) + " ELSE 'Private' END"
_SPECIALTY = "CASE s_suppkey % 6 " + " ".join(
    f"WHEN {i} THEN element_at({_list(kinds)}, cast(s_suppkey div 6 % {len(kinds)} + 1 AS int))"
    for i, (_, _, kinds) in enumerate(DEPARTMENTS)
) + " END"


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.SOURCE[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def encounters_to_bed_events(encounters: DataFrame, departments: DataFrame) -> DataFrame:
    """Two events per encounter, bed taken at admission and given back at discharge.

    An open encounter has no second event.
    """
    beds = departments.selectExpr("department_key", "greatest(bed_capacity, 1) AS capacity")
    return (
        encounters.select("encounter_key", "department_key", "admission_date", "discharge_date")
        .join(beds, "department_key", "left")
        .selectExpr(
            "encounter_key",
            "department_key",
            "cast(pmod(encounter_key * 29, coalesce(capacity, 1)) + 1 AS int) AS bed_number",
            "stack(2, encounter_key * 2, 'bed_assigned', admission_date, encounter_key * 2 + 1, 'bed_discharged', "
            "discharge_date) AS (bed_event_key, event_type, event_timestamp)",
        )
        .where("event_timestamp IS NOT NULL")
        .selectExpr(
            "bed_event_key", "encounter_key", "department_key", "bed_number", "event_type", "event_timestamp",
            "event_timestamp AS created_at",
        )
    )


class Star:
    """Lazy tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.events_as_of = EVENTS_AS_OF

    def source(self, name: str) -> DataFrame:
        return source_table(self.spark, self.sf_dir, name)

    @cached_property
    def departments(self) -> DataFrame:
        return reference_data(self.spark).select(
            "department_key", "department_id", "department_name", "bed_capacity", X.ts(EPOCH).alias("created_at")
        )

    @cached_property
    def physicians(self) -> DataFrame:
        return self.source("supplier").selectExpr(
            "s_suppkey AS physician_key",
            "s_name AS physician_id",
            "'Doctor' AS first_name",
            "s_name AS last_name",
            f"{_SPECIALTY} AS specialty",
            "s_suppkey % 6 + 1 AS department_key",
            f"timestamp_ntz'{EPOCH}' AS created_at",
        )

    @cached_property
    def patients(self) -> DataFrame:
        second = f"cast({_SECOND_FROM.format(k='c_custkey')} AS timestamp_ntz)"
        third = f"cast(add_months({_SECOND_FROM.format(k='c_custkey')}, 36) AS timestamp_ntz)"
        start = f"CASE record_version WHEN 1 THEN timestamp_ntz'{EPOCH}' WHEN 2 THEN {second} ELSE {third} END"
        end = (
            f"CASE WHEN record_version = versions THEN timestamp_ntz'{OPEN_END}' "
            f"WHEN record_version = 1 THEN {second} ELSE {third} END"
        )
        nation = self.source("nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS state")
        versions = (
            self.source("customer")
            .join(nation, "c_nationkey", "left")
            .selectExpr(
                "*", f"{_VERSIONS} AS versions", f"{_BASE_INSURANCE} AS base_insurance",
                f"explode(sequence(1, {_VERSIONS})) AS record_version",
            )
        )
        return versions.selectExpr(
            "c_custkey * 10 + record_version AS patient_key",
            "c_name AS patient_id",
            f"element_at({_list(FIRST_NAMES)}, cast(c_custkey % {len(FIRST_NAMES)} + 1 AS int)) AS first_name",
            f"element_at({_list(LAST_NAMES)}, cast(c_custkey div 10 % {len(LAST_NAMES)} + 1 AS int)) AS last_name",
            "date_add(date'1905-01-01', cast(c_custkey * 7919 % 36000 AS int)) AS date_of_birth",
            "CASE WHEN c_custkey % 100 < 49 THEN 'M' WHEN c_custkey % 100 < 98 THEN 'F' ELSE 'Other' END AS gender",
            "concat(c_custkey % 900 + record_version * 100, ' Elm Street') AS address",
            "concat('City ', (c_custkey * 3 + record_version * 7) % 50) AS city",
            "state",
            f"{_digits('cast((c_custkey * 31 + record_version) % 100000 AS string)', 5)} AS zip_code",
            f"concat('555-', {_digits('cast(c_custkey % 10000 AS string)', 4)}) AS phone_number",
            "CASE WHEN record_version < 3 THEN base_insurance WHEN base_insurance = 'Medicare' THEN 'Medicaid' "
            "ELSE 'Medicare' END AS insurance_type",
            f"{start} AS valid_from",
            f"{end} AS valid_to",
            "record_version = versions AS is_current",
            "record_version",
            f"{start} AS created_at",
            f"{start} AS updated_at",
        )

    @cached_property
    def encounters(self) -> DataFrame:
        physicians = self.source("supplier").selectExpr("count(*)").scalar()
        second = _SECOND_FROM.format(k="o_custkey")
        version = (
            f"1 + cast(o_custkey % 5 = 0 AND to_date(admission_date) >= {second} AS int) "
            f"+ cast(o_custkey % 25 = 0 AND to_date(admission_date) >= add_months({second}, 36) AS int)"
        )
        return (
            self.source("orders")
            .withColumn("physician_key", F.col("o_orderkey") % physicians)
            .selectExpr(
                "*", "cast(timestampadd(MINUTE, cast(o_orderkey * 37 % 1440 AS int), o_orderdate) AS timestamp_ntz) AS admission_date"
            )
            .selectExpr(
                "o_orderkey AS encounter_key",
                "concat('ENC-', o_orderkey) AS encounter_id",
                f"o_custkey * 10 + {version} AS patient_key",
                f"concat('Customer#', {_digits('cast(o_custkey AS string)', 9)}) AS patient_id",
                "physician_key % 6 + 1 AS department_key",
                "physician_key",
                "admission_date",
                "CASE WHEN o_orderkey % 97 <> 0 THEN cast(timestampadd(HOUR, cast(o_orderkey * 53 % 240 + 1 AS int), "
                "admission_date) AS timestamp_ntz) END AS discharge_date",
                "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Emergency' WHEN '2' THEN 'Emergency' "
                "WHEN '3' THEN 'Scheduled' WHEN '4' THEN 'Scheduled' WHEN '5' THEN 'Transfer' END AS admission_type",
                f"element_at({_list(COMPLAINTS)}, cast(o_orderkey % {len(COMPLAINTS)} + 1 AS int)) AS chief_complaint",
                "admission_date AS created_at",
            )
        )

    @cached_property
    def bed_events(self) -> DataFrame:
        return encounters_to_bed_events(self.encounters, self.departments)

    @cached_property
    def requests(self) -> DataFrame:
        """The request log: one row per monitoring event, duration in seconds."""
        return request_log(self.source("events"))

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_patients": self.patients,
            "dim_departments": self.departments,
            "dim_physicians": self.physicians,
            "fact_encounters": self.encounters,
            "fact_bed_events": self.bed_events,
        }


def request_log(events: DataFrame) -> DataFrame:
    """Works on a static or a streaming frame of events."""
    error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("timestamp"),
        F.when(error, "ERROR").otherwise("INFO").alias("severity"),
        F.lit("GET").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("path"),
        F.when(error, 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("duration_seconds"),
    )
