"""One clean fixture and one planted violation per rule."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import quality
from wardline.sources import schemas

D = datetime.fromisoformat
AS_OF, T0, END = "2025-09-01", D("2025-01-01"), D("9999-12-31T23:59:59")


def patient(key=1, pid="p1", first="Ann", dob="1980-01-01", start=T0, end=END, current=True, version=1):
    return (key, pid, first, "Lee", D(dob).date(), "F", None, None, None, None, None, "Private", start, end, current, version, T0, T0)


def encounter(key=1, pat=1, dept=1, a="2025-02-01", d="2025-02-03"):
    return (key, f"E{key}", pat, "p1", dept, 1, D(a), D(d) if d else None, "Emergency", "Fever", T0)


def event(key=1, enc=1, dept=1, bed=1):
    return (key, enc, dept, bed, "bed_assigned", T0, T0)


CLEAN = {
    "dim_patients": [patient()],
    "dim_departments": [(1, "D1", "Medical", 10, T0)],
    "dim_physicians": [(1, "D", "A", "B", "Cardiology", 1, T0)],
    "fact_encounters": [encounter()],
    "fact_bed_events": [event()],
}


def tables(spark, **rows):
    return {n: spark.createDataFrame(v, schemas.STAR[n]) for n, v in {**CLEAN, **rows}.items()}


def test_clean_tables_pass(spark):
    report = quality.run_rules(tables(spark), AS_OF)
    assert report.where("passed").count() == len(quality.RULES) == 12
    assert quality.summarize(report).first().asDict() == {
        "total_tests": 12, "passed": 12, "failed": 0, "errors": 0, "warnings": 0, "success": True}


PLANTED = [
    (quality.encounter_dates_present, dict(fact_encounters=[encounter(), encounter(2, d=None)]), [2]),
    (quality.encounter_patient_exists, dict(fact_encounters=[encounter(), encounter(2, pat=9), encounter(3, pat=None)]), [2, 3]),
    (quality.encounter_department_exists, dict(fact_encounters=[encounter(), encounter(2, dept=9)]), [2]),
    (quality.bed_event_encounter_exists, dict(fact_bed_events=[event(), event(2, enc=9)]), [2]),
    (quality.discharge_after_admission, dict(fact_encounters=[encounter(), encounter(2, d="2025-02-01")]), [2]),
    (quality.bed_within_capacity, dict(fact_bed_events=[event(), event(2, bed=0), event(3, bed=11), event(4, bed=10)]), [2, 3]),
    (quality.age_reasonable, dict(dim_patients=[patient(), patient(2, dob="2025-09-02"), patient(3, dob="1905-08-31"), patient(4, dob="1905-09-01")]), [2, 3]),
    (quality.one_current_row, dict(dim_patients=[patient(), patient(2, version=2)]), ["p1"]),
    (quality.no_history_gaps, dict(dim_patients=[patient(end=D("2025-03-01"), current=False), patient(2, start=D("2025-03-02"), version=2)]), ["p1"]),
    (quality.current_row_open, dict(dim_patients=[patient(), patient(2, "p2", end=D("2025-08-01"))]), [2]),
    (quality.department_has_physician, dict(dim_departments=[(1, "D1", "Medical", 10, T0), (2, "D2", "Surgical", 10, T0)]), [2]),
]


@pytest.mark.parametrize("rule, rows, want", PLANTED, ids=[p[0].__name__ for p in PLANTED])
def test_planted_violation(spark, rule, rows, want):
    got = rule(tables(spark, **rows), AS_OF).collect()
    assert sorted(r[0] for r in got) == want


def test_null_name(spark):
    t = tables(spark)
    t["dim_patients"] = t["dim_patients"].withColumn("first_name", F.lit(None).cast("string"))
    assert quality.patient_names_present(t, AS_OF).count() == 1


def test_warning_does_not_fail_the_run(spark):
    t = tables(spark, dim_departments=[(1, "D1", "Medical", 10, T0), (2, "D2", "Surgical", 10, T0)])
    summary = quality.summarize(quality.run_rules(t, AS_OF)).first()
    assert (summary.warnings, summary.errors, summary.success) == (1, 0, True)


def test_samples_are_the_five_smallest(spark):
    t = tables(spark, fact_encounters=[encounter(k, d=None) for k in range(20, 0, -1)])
    rule = next(r for r in quality.RULES if r.build is quality.encounter_dates_present)
    row = quality.run_rules(t, AS_OF, [rule]).first()
    assert (row.failure_count, row.failed_records) == (20, ["1", "2", "3", "4", "5"])


def test_user_rules(spark):
    rules = []
    quality.register_rule(rules, "text", "SELECT encounter_key FROM {fact_encounters} WHERE admission_type = 'Emergency'", "warning")
    quality.register_rule(rules, "function", lambda t, as_of: t["dim_patients"].where("false").select("patient_key"))
    got = {r.test_name: r.passed for r in quality.run_rules(tables(spark), AS_OF, rules).collect()}
    assert got == {"text": False, "function": True}


def test_row_rules(spark):
    rows = [
        (1, D("2025-01-01"), D("2025-01-31"), "10", 0.5, "x", 3, "e"), (2, D("2025-01-31"), D("2025-01-01"), "0", 0.0, "x", 3, "e"),
        (3, D("2025-10-01"), D("2025-10-02"), "-5", 1.0, "x", 3, "e"), (4, D("2025-01-01"), D("2025-01-01"), "ten", 1.5, None, 3, "e"),
        (5, D("2025-01-01"), D("2025-01-31"), None, -0.1, "x", None, "e"), (6, D("2025-01-01"), None, "9" * 30, None, "x", 3, None),
    ]
    df = spark.createDataFrame(rows, "k long, a timestamp_ntz, b timestamp_ntz, n string, p double, name string, age int, email string")
    got = quality.row_violations(df, "k", {
        "range": quality.bad_date_range("a", "b", AS_OF), "integer": quality.not_positive_integer("n"),
        "probability": quality.not_probability("p"), "required": quality.missing_fields(df, ["name", "age", "email"])})
    found = {}
    for r in got.collect():
        found.setdefault(r.rule, []).append(r.k)
    assert {k: sorted(v) for k, v in found.items()} == {
        "range": [2, 3, 4], "integer": [2, 3, 4, 5], "probability": [4, 5, 6], "required": [4, 5, 6]}
    assert quality.row_violations(df, "k", {"r": quality.missing_fields(df, ["absent"])}).count() == 6
    whole = df.select("k", F.lit(3).alias("n"))
    assert quality.row_violations(whole, "k", {"i": quality.not_positive_integer("n")}).count() == 0


def test_column_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    assert [(r.k, r.occurrences) for r in quality.unique_violations(df, "k").collect()] == [(1, 2)]
    assert [r.v for r in quality.not_null_violations(df, "k", "v").collect()] == ["c"]


def test_age(spark):
    def age(dob, as_of):
        return spark.range(1).select(X.age_years(X.day_lit(dob), as_of)).first()[0]

    assert [age("2000-02-29", d) for d in ("2021-02-28", "2021-03-01", "2024-02-28", "2024-02-29")] == [20, 21, 23, 24]
    assert [age("1980-09-01", AS_OF), age("1980-09-02", AS_OF)] == [45, 44]
