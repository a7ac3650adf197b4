"""Data-quality rules. A rule yields the violating rows; none means it passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.history import version_pairs
from wardline.operators.relations import orphans
from wardline.sources.tables import materialize, run_sql

Tables = Mapping[str, DataFrame]
SAMPLES = 5


@dataclass(frozen=True)
class Rule:
    """``build`` takes the tables and the reference date and returns one column of violating keys.

    A rule about single rows says so: ``row`` names its table, its key, and the condition of a violation
    at a reference date. Rules about rows of one table are tested together, in one pass.
    """

    name: str
    build: Callable[[Tables, str], DataFrame]
    severity: str = "error"
    description: str = ""
    row: tuple[str, str, Callable[[str], Column]] | None = None


# --- rules of the star --------------------------------------------------------------------------


def _violations(row: tuple[str, str, Callable[[str], Column]], t: Tables, as_of: str) -> DataFrame:
    table, key, broken = row
    return t[table].where(broken(as_of)).select(key)


def _name_missing(as_of: str) -> Column:
    return F.col("first_name").isNull() | F.col("last_name").isNull()


def _date_missing(as_of: str) -> Column:
    return F.col("admission_date").isNull() | F.col("discharge_date").isNull()


def _ends_before_it_begins(as_of: str) -> Column:
    return F.col("discharge_date") <= F.col("admission_date")


def _age_out_of_range(as_of: str) -> Column:
    today, born = X.day_lit(as_of), F.col("date_of_birth")
    return (born > today) | (born < F.add_months(today, -12 * 120))


def _current_but_closed(as_of: str) -> Column:
    return F.col("is_current") & (F.col("valid_to") < X.ts(as_of))


NAMES = ("dim_patients", "patient_key", _name_missing)
DATES = ("fact_encounters", "encounter_key", _date_missing)
ORDER = ("fact_encounters", "encounter_key", _ends_before_it_begins)
AGES = ("dim_patients", "patient_key", _age_out_of_range)
OPEN = ("dim_patients", "patient_key", _current_but_closed)


def patient_names_present(t: Tables, as_of: str) -> DataFrame:
    return _violations(NAMES, t, as_of)


def encounter_dates_present(t: Tables, as_of: str) -> DataFrame:
    return _violations(DATES, t, as_of)


def encounter_patient_exists(t: Tables, as_of: str) -> DataFrame:
    return orphans(t["fact_encounters"], t["dim_patients"], "patient_key").select("encounter_key")


def encounter_department_exists(t: Tables, as_of: str) -> DataFrame:
    return orphans(t["fact_encounters"], t["dim_departments"], "department_key").select("encounter_key")


def bed_event_encounter_exists(t: Tables, as_of: str) -> DataFrame:
    return orphans(t["fact_bed_events"], t["fact_encounters"], "encounter_key").select("bed_event_key")


def discharge_after_admission(t: Tables, as_of: str) -> DataFrame:
    return _violations(ORDER, t, as_of)


def bed_within_capacity(t: Tables, as_of: str) -> DataFrame:
    beds = t["fact_bed_events"].join(t["dim_departments"].select("department_key", "bed_capacity"), "department_key")
    outside = (F.col("bed_number") > F.col("bed_capacity")) | (F.col("bed_number") < 1)
    return beds.where(outside).select("bed_event_key")


def age_reasonable(t: Tables, as_of: str) -> DataFrame:
    return _violations(AGES, t, as_of)


def one_current_row(t: Tables, as_of: str) -> DataFrame:
    counts = t["dim_patients"].where("is_current").groupBy("patient_id").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > 1).select("patient_id")


def no_history_gaps(t: Tables, as_of: str) -> DataFrame:
    pairs = version_pairs(t["dim_patients"], "patient_id", ["valid_from", "valid_to"])
    return pairs.where(F.col("old_valid_to") != F.col("new_valid_from")).select(F.col("old_patient_id").alias("patient_id"))


def current_row_open(t: Tables, as_of: str) -> DataFrame:
    return _violations(OPEN, t, as_of)


def department_has_physician(t: Tables, as_of: str) -> DataFrame:
    return orphans(t["dim_departments"], t["dim_physicians"].where("physician_key IS NOT NULL"), "department_key").select(
        "department_key"
    )


# Names, severities and descriptions of the published checks.
RULES = [
    Rule("Patients have no NULL names", patient_names_present, "error",
         "Patient first_name and last_name must never be NULL", NAMES),
    Rule("Encounters have valid dates", encounter_dates_present, "error",
         "Every encounter must have both admission and discharge dates", DATES),
    Rule("All encounters reference valid patients", encounter_patient_exists, "error",
         "Every encounter must reference an existing patient record"),
    Rule("All encounters reference valid departments", encounter_department_exists, "error",
         "Every encounter must reference an existing department"),
    Rule("All bed events reference valid encounters", bed_event_encounter_exists, "error",
         "Every bed event must reference an existing encounter"),
    Rule("Discharge dates after admission dates", discharge_after_admission, "error",
         "Discharge date must always be after admission date", ORDER),
    Rule("Bed numbers within capacity", bed_within_capacity, "error",
         "Bed numbers must be between 1 and the department's bed_capacity"),
    Rule("Patient ages are reasonable", age_reasonable, "error",
         "Patient date_of_birth must produce an age between 0 and 120 years", AGES),
    Rule("Only one current record per patient", one_current_row, "error",
         "Each patient_id must have exactly one row where is_current = TRUE"),
    Rule("No gaps in patient history", no_history_gaps, "error",
         "valid_to of version N must equal valid_from of version N+1 (no history gaps)"),
    Rule("Current records have valid_to in future", current_row_open, "error",
         "Any record marked is_current = TRUE must have valid_to in the future", OPEN),
    Rule("All departments have physicians", department_has_physician, "warning",
         "Each department should have at least one physician assigned"),
]


# --- column tests and user rules ----------------------------------------------------------------


def unique_violations(df: DataFrame, col: str) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("occurrences"))
    return counts.where(F.col("occurrences") > 1)


def not_null_violations(df: DataFrame, col: str, key: str) -> DataFrame:
    return df.where(F.col(col).isNull()).select(key)


# Column tests of the models.
COLUMN_TESTS = [
    ("stg_patients", "patient_key", "not_null"),
    ("stg_patients", "patient_key", "unique"),
    ("stg_encounters", "encounter_key", "not_null"),
    ("stg_encounters", "encounter_key", "unique"),
    ("stg_encounters", "length_of_stay_days", "not_null"),
    ("int_patient_encounters", "encounter_key", "not_null"),
    ("int_patient_encounters", "encounter_key", "unique"),
]


def column_tests(models: Tables) -> DataFrame:
    """Failing rows (not_null) or values (unique) per declared column test."""
    parts = []
    for model, col, kind in COLUMN_TESTS:
        df = models[model]
        bad = unique_violations(df, col) if kind == "unique" else df.where(F.col(col).isNull())
        parts.append(
            bad.agg(F.count("*").alias("failures")).select(
                F.lit(model).alias("model"), F.lit(col).alias("column_name"), F.lit(kind).alias("test"), "failures"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def register_rule(
    rules: list[Rule], name: str, check: Callable[[Tables, str], DataFrame] | str, severity: str = "error", description: str = ""
) -> Rule:
    """Adds a rule given as a function or as SQL text over ``{table}`` names."""
    if isinstance(check, str):
        text = check

        def build(tables: Tables, as_of: str) -> DataFrame:
            spark: SparkSession = next(iter(tables.values())).sparkSession
            named = {n: df for n, df in tables.items() if "{" + n + "}" in text}
            return run_sql(spark, text, None, **named)
    else:
        build = check
    rule = Rule(name, build, severity, description)
    rules.append(rule)
    return rule


# --- row rules ----------------------------------------------------------------------------------


def bad_date_range(start: str, end: str, as_of: str) -> Column:
    """Start not before end, or start in the future."""
    return F.coalesce((F.col(start) >= F.col(end)) | (F.col(start) > X.ts(as_of)), F.lit(False))


def not_positive_integer(col: str) -> Column:
    """Not a whole number above zero; NULL and other text count as wrong."""
    number = F.col(col).cast("string")
    return ~F.coalesce(number.rlike(r"^[+]?[0-9]+$") & (number.try_cast("decimal(38,0)") > 0), F.lit(False))


def not_probability(col: str) -> Column:
    return ~F.coalesce(F.col(col).between(0, 1), F.lit(False))


def missing_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    """True if a field is NULL or the frame does not have it at all."""
    tests = [F.col(f).isNull() if f in df.columns else F.lit(True) for f in fields]
    return reduce(lambda a, b: a | b, tests)


def row_violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per record and broken rule, in a single pass over the data."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


NUMBERS = ("tinyint", "smallint", "int", "bigint")


# --- running ------------------------------------------------------------------------------------


def _by_table(rules: Sequence[Rule]) -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for i, rule in enumerate(rules):
        if rule.row is not None:
            out.setdefault(rule.row[0], []).append((i, rule))
    return out


def _key(df: DataFrame, name: str) -> list[Column]:
    number = F.col(name).cast("bigint") if df.schema[name].dataType.simpleString() in NUMBERS else F.lit(None).cast("bigint")
    return [number.alias("number"), F.col(name).cast("string").alias("key")]


def _of_rows(df: DataFrame, as_of: str, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Violations of all rules about the rows of one table, from one scan."""
    broken = [F.when(rule.row[2](as_of), F.struct(F.lit(i).alias("rule"), *_key(df, rule.row[1]))) for i, rule in rules]
    return df.select(F.explode(F.array_compact(F.array(*broken))).alias("v")).select("v.*")


def run_rules(tables: Tables, as_of: str, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Per rule the number of violations and the smallest violating keys.

    Every rule's violations are found once, in one job, and staged as (rule, key); counts and samples
    are read from there. Rules about single rows of a table share its scan; one about keys of several
    tables or rows has its own.
    """
    found = [_of_rows(tables[table], as_of, own) for table, own in _by_table(rules).items()]
    for i, rule in enumerate(rules):
        if rule.row is None:
            bad = rule.build(tables, as_of)
            found.append(bad.select(F.lit(i).alias("rule"), *_key(bad, bad.columns[0])))
    spark = found[0].sparkSession
    broken = materialize(reduce(DataFrame.unionByName, found), "violations")
    counts = broken.groupBy("rule").agg(F.count("*").alias("failure_count"))
    order = Window.partitionBy("rule").orderBy(F.col("number").asc_nulls_last(), F.col("key").asc_nulls_last())
    first = broken.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLES)
    samples = first.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "key"))), lambda x: x["key"]).alias("failed_records"))
    named = spark.createDataFrame(
        [(i, r.name, r.severity, r.description) for i, r in enumerate(rules)],
        "rule int, test_name string, severity string, description string",
    )
    out = named.join(counts, "rule", "left").join(samples, "rule", "left")
    count = F.coalesce("failure_count", F.lit(0))
    return out.select(
        "test_name", (count == 0).alias("passed"), "severity", "description", count.alias("failure_count"),
        F.coalesce("failed_records", F.array().cast("array<string>")).alias("failed_records"),
    )


def summarize(report: DataFrame) -> DataFrame:
    """Totals; a run is successful when no rule of severity error failed."""
    failed = ~F.col("passed")
    errors = X.count_where(failed & (F.col("severity") == "error"))
    return report.agg(
        F.count("*").alias("total_tests"),
        X.count_where(F.col("passed")).alias("passed"),
        X.count_where(failed).alias("failed"),
        errors.alias("errors"),
        X.count_where(failed & (F.col("severity") == "warning")).alias("warnings"),
    ).withColumn("success", F.col("errors") == 0)
