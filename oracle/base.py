"""The star adapter as DuckDB CTEs, and the helpers the topic modules share."""

from __future__ import annotations

import re

from wardline.functions import exprs as X
from wardline.sources import star as S
from wardline.sources.reference import COMPLAINTS, DEPARTMENTS

AS_OF = S.AS_OF
EVENTS_AS_OF = S.EVENTS_AS_OF


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(col: str, mapping: dict, default: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} {'ELSE ' + repr(default) if default else ''} END"


_SPECIALTY = "CASE s_suppkey % 6 " + " ".join(
    f"WHEN {i} THEN {_list(kinds)}[(s_suppkey // 6) % {len(kinds)} + 1]" for i, (_, _, kinds) in enumerate(DEPARTMENTS)
) + " END"
_SECOND = "(DATE '1997-01-01' + (c_custkey % 365)::INT)"

CTES = {
    "dim_departments": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}::BIGINT, 'DEPT-{i}', '{name}', {beds}::INT, TIMESTAMP '{S.EPOCH}')"
        for i, (name, beds, _) in enumerate(DEPARTMENTS, 1)
    )
    + ") t(department_key, department_id, department_name, bed_capacity, created_at)",
    "dim_physicians": f"""SELECT s_suppkey AS physician_key, s_name AS physician_id, 'Doctor' AS first_name,
        s_name AS last_name, {_SPECIALTY} AS specialty, s_suppkey % 6 + 1 AS department_key,
        TIMESTAMP '{S.EPOCH}' AS created_at FROM supplier""",
    "patient_versions": f"""SELECT c.*, n_name AS state, v AS version,
        CASE WHEN c_custkey % 25 = 0 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS versions,
        {_SECOND}::TIMESTAMP AS second_from, ({_SECOND} + INTERVAL 3 YEAR)::TIMESTAMP AS third_from,
        {_case('c_mktsegment', S.INSURANCE_BY_SEGMENT, 'Private')} AS base_insurance
        FROM customer c LEFT JOIN nation ON n_nationkey = c_nationkey, range(1, 4) r(v)
        WHERE v <= CASE WHEN c_custkey % 25 = 0 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END""",
    "dim_patients": f"""SELECT c_custkey * 10 + version AS patient_key, c_name AS patient_id,
        {_list(S.FIRST_NAMES)}[c_custkey % {len(S.FIRST_NAMES)} + 1] AS first_name,
        {_list(S.LAST_NAMES)}[(c_custkey // 10) % {len(S.LAST_NAMES)} + 1] AS last_name,
        DATE '1905-01-01' + (c_custkey * 7919 % 36000)::INT AS date_of_birth,
        CASE WHEN c_custkey % 100 < 49 THEN 'M' WHEN c_custkey % 100 < 98 THEN 'F' ELSE 'Other' END AS gender,
        printf('%d Elm Street', c_custkey % 900 + version * 100) AS address,
        printf('City %d', (c_custkey * 3 + version * 7) % 50) AS city, state,
        printf('%05d', (c_custkey * 31 + version) % 100000) AS zip_code,
        printf('555-%04d', c_custkey % 10000) AS phone_number,
        CASE WHEN version < 3 THEN base_insurance WHEN base_insurance = 'Medicare' THEN 'Medicaid'
             ELSE 'Medicare' END AS insurance_type,
        CASE version WHEN 1 THEN TIMESTAMP '{S.EPOCH}' WHEN 2 THEN second_from ELSE third_from END AS valid_from,
        CASE WHEN version = versions THEN TIMESTAMP '{S.OPEN_END}' WHEN version = 1 THEN second_from
             ELSE third_from END AS valid_to,
        version = versions AS is_current, version::INT AS record_version,
        CASE version WHEN 1 THEN TIMESTAMP '{S.EPOCH}' WHEN 2 THEN second_from ELSE third_from END AS created_at,
        CASE version WHEN 1 THEN TIMESTAMP '{S.EPOCH}' WHEN 2 THEN second_from ELSE third_from END AS updated_at
        FROM patient_versions""",
    "encounter_base": """SELECT *, o_orderdate + to_minutes(o_orderkey * 37 % 1440) AS admission_date,
        o_orderkey % (SELECT count(*) FROM supplier) AS physician_key FROM orders""",
    "encounter_stays": """SELECT *, CASE WHEN o_orderkey % 97 <> 0
        THEN admission_date + to_hours(1 + o_orderkey * 53 % 240) END AS discharge_date,
        (DATE '1997-01-01' + (o_custkey % 365)::INT) AS second_from FROM encounter_base""",
    "fact_encounters": f"""SELECT o_orderkey AS encounter_key, printf('ENC-%d', o_orderkey) AS encounter_id,
        o_custkey * 10 + 1 + (o_custkey % 5 = 0 AND admission_date::DATE >= second_from)::INT
          + (o_custkey % 25 = 0 AND admission_date::DATE >= (second_from + INTERVAL 3 YEAR)::DATE)::INT AS patient_key,
        printf('Customer#%09d', o_custkey) AS patient_id, physician_key % 6 + 1 AS department_key, physician_key,
        admission_date, discharge_date,
        CASE o_orderpriority[1] WHEN '1' THEN 'Emergency' WHEN '2' THEN 'Emergency' WHEN '3' THEN 'Scheduled'
             WHEN '4' THEN 'Scheduled' WHEN '5' THEN 'Transfer' END AS admission_type,
        {_list(COMPLAINTS)}[o_orderkey % {len(COMPLAINTS)} + 1] AS chief_complaint, admission_date AS created_at,
        epoch_us(discharge_date) - epoch_us(admission_date) AS los_us,
        (epoch_us(discharge_date) - epoch_us(admission_date)) / 86400e6 AS los
        FROM encounter_stays""",
    "bed_slots": """SELECT e.*, 1 + e.encounter_key * 29 % d.bed_capacity AS bed
        FROM fact_encounters e JOIN dim_departments d USING (department_key)""",
    "fact_bed_events": """SELECT encounter_key * 2 AS bed_event_key, encounter_key, department_key,
        bed::INT AS bed_number, 'bed_assigned' AS event_type, admission_date AS event_timestamp,
        admission_date AS created_at FROM bed_slots
        UNION ALL SELECT encounter_key * 2 + 1, encounter_key, department_key, bed::INT, 'bed_discharged',
        discharge_date, discharge_date FROM bed_slots WHERE discharge_date IS NOT NULL""",
    "requests": """SELECT event_id AS request_id, ts AS "timestamp",
        CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, 'GET' AS method,
        '/' || event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
        value / 100 AS duration_seconds FROM events""",
}


def with_star(body: str, extra: dict[str, str] | None = None) -> str:
    """Puts the CTEs that ``body`` names, directly or through others, in front of it.

    ``extra`` are CTEs of the query's own; ``body`` is the final SELECT.
    """
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body


def rnd(x: str, n: int) -> str:
    """Decimal half-up rounding of a double."""
    return f"round(CAST({x} AS DECIMAL(38,12)), {n})::DOUBLE"


def pct(num: str, den: str, n: int = 2) -> str:
    return rnd(f"({num})::DOUBLE / nullif(({den})::DOUBLE, 0) * 100", n)


_SEC = "(sum({c} // 1000000) + sum({c} % 1000000) / 1e6)"


def mean_days(c: str = "los_us") -> str:
    return f"({_SEC.format(c=c)} / nullif(count({c}), 0) / 86400e0)"


def mean_hours(c: str = "los_us") -> str:
    return f"({_SEC.format(c=c)} / nullif(count({c}), 0) / 3600e0)"


def total_days(c: str = "los_us") -> str:
    return f"({_SEC.format(c=c)} / 86400e0)"


def quantile_days(q: float, c: str = "los_us") -> str:
    return f"(quantile_cont({c}, {q}) / 86400e6)"


def ctype(kind: str) -> str:
    return f"count(CASE WHEN admission_type = '{kind}' THEN 1 END)"


def age(dob: str, as_of: str = AS_OF) -> str:
    return (
        f"(year(DATE '{as_of}') - year({dob}) - (month({dob}) * 100 + day({dob}) > "
        f"month(DATE '{as_of}') * 100 + day(DATE '{as_of}'))::INT)"
    )


def bucket(x: str, spec: tuple) -> str:
    bounds, last = spec
    return "CASE " + " ".join(f"WHEN {x} < {u} THEN '{label}'" for u, label in bounds) + f" ELSE '{last}' END"


def day_name(x: str) -> str:
    return f"{_list(X.DAY_NAMES)}[dayofweek({x}) + 1]"


def weekday_flag(x: str) -> str:
    return f"CASE WHEN dayofweek({x}) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END"
