"""Reference data of the hospital: departments, specialties, complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Department name, bed capacity, specialties.
DEPARTMENTS = [
    ("Emergency Department", 20, ["Emergency Medicine"]),
    ("Intensive Care Unit", 15, ["Critical Care", "Pulmonology"]),
    ("Medical", 50, ["Internal Medicine", "Cardiology", "Nephrology"]),
    ("Surgical", 40, ["General Surgery", "Orthopedics", "Neurosurgery"]),
    ("Obstetrics", 25, ["Obstetrics", "Gynecology"]),
    ("Pediatrics", 30, ["Pediatrics", "Neonatology"]),
]

# Chief complaints.
COMPLAINTS = [
    "Chest pain",
    "Shortness of breath",
    "Abdominal pain",
    "Fever",
    "Headache",
    "Back pain",
    "Nausea and vomiting",
    "Dizziness",
    "Injury/Trauma",
    "Altered mental status",
]


def reference_data(spark: SparkSession) -> DataFrame:
    """One row per department with capacity and specialties."""
    rows = ", ".join(
        f"({i}L, 'DEPT-{i}', '{name}', {beds}, array({', '.join(repr(k) for k in kinds)}))"
        for i, (name, beds, kinds) in enumerate(DEPARTMENTS, 1)
    )
    # An inline table has a known size, so joins to it are planned as broadcasts from the start.
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(department_key, department_id, department_name, bed_capacity, specialties)"
    )
