"""SQL of the history, loading, quality, occupancy, monitoring and model queries."""

from __future__ import annotations

import re

from oracle.base import AS_OF, age, bucket, mean_days, quantile_days, rnd, with_star
from oracle.reports import EXTRA, SQL as REPORTS
from wardline.functions import exprs as X
from wardline.operators.quality import RULES
from wardline.plans import feeds, learning, risk
from wardline.plans.marts import VIEWS
from wardline.sources.reference import DEPARTMENTS
from wardline.streaming.monitor import DURATION_BOUNDS

PATIENT = "Customer#000000025"
SQL: dict[str, str] = {}

_FIELDS = ", ".join(feeds.PATIENT_FIELDS)
_OTHER = [c for c in feeds.PATIENT_FIELDS if c not in ("patient_id", *feeds.TRACKED)]


def _distinct(prefix: str) -> str:
    return "(" + " OR ".join(f"{c} IS DISTINCT FROM {prefix}_{c}" for c in feeds.TRACKED) + ")"


CARE = {
    **EXTRA,
    "moved": f"""SELECT * REPLACE (CASE WHEN gender = 'F' THEN address || ' Apt 2' ELSE address END AS address)
        FROM (SELECT {_FIELDS} FROM dim_patients WHERE is_current)""",
    "feed": f"""SELECT *, TIMESTAMP '{feeds.FIRST_BATCH}' AS effective_at FROM moved
        UNION ALL SELECT * REPLACE (CASE WHEN date_of_birth < DATE '1936-09-01' THEN 'Medicare' ELSE insurance_type END
          AS insurance_type), TIMESTAMP '{feeds.SECOND_BATCH}' FROM moved
        UNION ALL SELECT physician_id, first_name, last_name, DATE '1960-01-01' + (physician_key % 5000)::INT, 'Other',
          'Staff House', 'City 1', NULL, NULL, NULL, 'Private', TIMESTAMP '{feeds.FIRST_BATCH}' FROM dim_physicians""",
    "feed_seq": f"""SELECT f.*, c.record_version AS cur_version, c.valid_from AS cur_from,
        {', '.join(f'c.{c} AS cur_{c}' for c in feeds.PATIENT_FIELDS[1:])},
        row_number() OVER w AS seq, {', '.join(f'lag(f.{c}) OVER w AS prev_{c}' for c in feeds.TRACKED)}
        FROM feed f LEFT JOIN dim_patients c ON c.patient_id = f.patient_id AND c.is_current
        WHERE c.valid_from IS NULL OR f.effective_at > c.valid_from
        WINDOW w AS (PARTITION BY f.patient_id ORDER BY f.effective_at)""",
    "opened": f"""SELECT *, (coalesce(cur_version, 0) + row_number() OVER w)::INT AS new_version,
        lead(effective_at) OVER w AS next_at FROM feed_seq
        WHERE CASE WHEN seq > 1 THEN {_distinct('prev')} WHEN cur_version IS NOT NULL THEN {_distinct('cur')} ELSE TRUE END
        WINDOW w AS (PARTITION BY patient_id ORDER BY effective_at)""",
    "merged": f"""SELECT * FROM dim_patients WHERE NOT is_current
        UNION ALL BY NAME SELECT * EXCLUDE (closed_on) REPLACE (coalesce(closed_on, valid_to) AS valid_to,
          coalesce(closed_on, updated_at) AS updated_at, closed_on IS NULL AS is_current) FROM dim_patients p
          LEFT JOIN (SELECT patient_id, min(effective_at) AS closed_on FROM opened GROUP BY 1) o USING (patient_id) WHERE is_current
        UNION ALL BY NAME SELECT (SELECT max(patient_key) FROM dim_patients) + row_number() OVER (ORDER BY
            substr(md5(patient_id || '|' || new_version), 1, 3), patient_id, new_version) AS patient_key, patient_id,
          {', '.join(f'CASE WHEN cur_version IS NULL THEN {c} ELSE cur_{c} END AS {c}' for c in _OTHER)},
          {', '.join(feeds.TRACKED)}, effective_at AS valid_from, coalesce(next_at, TIMESTAMP '9999-12-31 23:59:59') AS valid_to,
          next_at IS NULL AS is_current, new_version AS record_version, effective_at AS created_at, coalesce(next_at, effective_at) AS updated_at
          FROM opened""",
    "labelled": f"""SELECT f.patient_id, f.effective_at, CASE WHEN p.patient_id IS NULL THEN 'new'
        WHEN {' OR '.join(f'f.{c} IS DISTINCT FROM p.{c}' for c in feeds.TRACKED)} THEN 'updated' ELSE 'unchanged' END
        AS change_type FROM feed f LEFT JOIN dim_patients p ON p.patient_id = f.patient_id AND p.is_current""",
    "load_history": """SELECT ((d - DATE '1990-01-01') * 2 + no)::BIGINT AS load_id, t AS table_name, n AS records_loaded,
        d::TIMESTAMP AS start_time, d::TIMESTAMP + to_milliseconds(n * 250) AS end_time,
        (n * 0.25)::DECIMAL(10,2) AS duration_seconds, d::TIMESTAMP + to_milliseconds(n * 250) AS created_at FROM (
        SELECT created_at::DATE AS d, 0 AS no, 'fact_encounters' AS t, count(*) AS n FROM fact_encounters GROUP BY 1
        UNION ALL SELECT created_at::DATE, 1, 'open_stays', count(*) FILTER (WHERE discharge_date IS NULL)
        FROM fact_encounters GROUP BY 1)""",
    "training": f"""SELECT f.encounter_key, encounter_id, f.patient_id, admission_date, discharge_date, los AS length_of_stay,
        'General' AS diagnosis_category, department_name, {age('date_of_birth')} AS age, insurance_type, num_previous_visits,
        CASE WHEN EXISTS (SELECT 1 FROM fact_encounters r WHERE r.patient_id = f.patient_id
          AND r.encounter_key <> f.encounter_key AND r.admission_date BETWEEN f.discharge_date
          AND f.discharge_date + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS readmitted_30d, chief_complaint
        FROM (SELECT *, count(*) OVER (PARTITION BY patient_id ORDER BY admission_date, encounter_key
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS num_previous_visits FROM fact_encounters) f
        JOIN dim_departments d USING (department_key)
        JOIN dim_patients p ON p.patient_id = f.patient_id AND p.is_current
        WHERE discharge_date IS NOT NULL AND los > 0""",
    "asks": f"""SELECT encounter_key, greatest({age('date_of_birth')}, 0) AS age, (gender = 'M')::INT AS is_male,
        (admission_type = 'Emergency')::INT AS is_emergency, (insurance_type = 'Uninsured')::INT AS is_uninsured,
        los AS los_days, floor(los)::BIGINT AS length_of_stay, prior_visits, bed_capacity,
        department_name, admission_type, insurance_type,
        chief_complaint IN ('Chest pain', 'Shortness of breath') AS has_chronic,
        (dayofweek(admission_date) + 6) % 7 AS day_of_week, hour(admission_date) AS hour_of_day
        FROM (SELECT *, count(*) OVER (PARTITION BY patient_id ORDER BY admission_date, encounter_key
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_visits FROM fact_encounters) e
        JOIN dim_patients p USING (patient_key) JOIN dim_departments d USING (department_key)
        WHERE discharge_date IS NOT NULL""",
}


def q(name: str, body: str, **extra: str) -> None:
    SQL[name] = with_star(body, {**CARE, **extra})


q("existing_patients_seen_in_emergency", """SELECT patient_key, patient_id FROM dim_patients WHERE patient_key IN
    (SELECT patient_key FROM fact_encounters WHERE admission_type = 'Emergency')""")
q("orphans_patient_versions_without_visit", """SELECT p.patient_key, p.patient_id FROM dim_patients p
    LEFT JOIN fact_encounters e ON e.patient_key = p.patient_key WHERE e.patient_key IS NULL""")
q("readmitted_flag", """SELECT patient_id, encounter_key, admission_date, discharge_date, CASE WHEN EXISTS (SELECT 1
    FROM fact_encounters r WHERE r.patient_id = f.patient_id AND r.encounter_key <> f.encounter_key AND r.admission_date
    BETWEEN f.discharge_date AND f.discharge_date + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS readmitted_30d FROM fact_encounters f""")
q("temporal_join", """SELECT f.patient_id, encounter_key, admission_date, record_version, valid_from, valid_to, insurance_type, city
    FROM fact_encounters f JOIN dim_patients p ON p.patient_id = f.patient_id AND valid_from <= admission_date
    AND admission_date < valid_to""")
_CHAINS = """SELECT * FROM (WITH RECURSIVE chain AS (
      SELECT encounter_key, encounter_key AS first_encounter_key, 0::BIGINT AS depth FROM visit_links WHERE previous IS NULL
      UNION ALL SELECT l.encounter_key, c.first_encounter_key, c.depth + 1 FROM visit_links l JOIN chain c ON l.previous = c.encounter_key)
    SELECT * FROM chain)"""
_LINKS = """SELECT encounter_key, CASE WHEN patient_id IS NOT NULL AND admission_date BETWEEN lag(discharge_date) OVER w
    AND lag(discharge_date) OVER w + INTERVAL 30 DAY THEN lag(encounter_key) OVER w END AS previous
    FROM fact_encounters WINDOW w AS (PARTITION BY patient_id ORDER BY admission_date, encounter_key)"""
q("readmission_chains", _CHAINS, visit_links=_LINKS)
q("readmission_chain_lengths", f"""SELECT visits, count(*) AS chains FROM (
    SELECT count(*) AS visits FROM ({_CHAINS}) GROUP BY first_encounter_key) GROUP BY visits""", visit_links=_LINKS)
q("bed_stays", """SELECT a.encounter_key, a.department_key, a.bed_number, a.event_timestamp AS assigned_at,
    d.event_timestamp AS discharged_at FROM fact_bed_events a LEFT JOIN fact_bed_events d
    ON a.encounter_key = d.encounter_key AND d.event_type = 'bed_discharged' WHERE a.event_type = 'bed_assigned'""")
q("bed_utilization", f"""SELECT department_name, slot::DATE AS slot_date, hour(slot) AS hour, count(DISTINCT bed_number) AS occupied_beds,
    bed_capacity, {rnd('count(DISTINCT bed_number)::DOUBLE / bed_capacity * 100', 1)} AS occupancy_rate_pct
    FROM (SELECT a.department_key, a.bed_number, unnest(generate_series(
        CASE WHEN date_trunc('hour', a.event_timestamp) = a.event_timestamp THEN a.event_timestamp
             ELSE date_trunc('hour', a.event_timestamp) + INTERVAL 1 HOUR END,
        least(coalesce(date_trunc('hour', d.event_timestamp - INTERVAL 1 MICROSECOND), hi), hi), INTERVAL 1 HOUR)) AS slot
      FROM fact_bed_events a LEFT JOIN fact_bed_events d ON a.encounter_key = d.encounter_key AND d.event_type = 'bed_discharged'
      JOIN (SELECT department_key, date_trunc('hour', max(event_timestamp)) AS hi FROM fact_bed_events GROUP BY 1) b
        ON b.department_key = a.department_key
      WHERE a.event_type = 'bed_assigned') s JOIN dim_departments USING (department_key)
    GROUP BY department_name, slot, bed_capacity""")
_LEVELS = """SELECT e.department_key, department_name, bed_number, event_timestamp, bed_event_key, event_type, encounter_key,
    occupancy_level, CASE WHEN occupancy_level > 0 THEN 'Occupied' ELSE 'Available' END AS bed_status
    FROM (SELECT *, (1 + coalesce(sum(CASE event_type WHEN 'bed_assigned' THEN 1 WHEN 'bed_discharged' THEN -1 ELSE 0 END)
        OVER (PARTITION BY department_key, bed_number ORDER BY event_timestamp, bed_event_key), 0)
      - first_value(CASE event_type WHEN 'bed_assigned' THEN 1 WHEN 'bed_discharged' THEN -1 ELSE 0 END)
        OVER (PARTITION BY department_key, bed_number ORDER BY event_timestamp, bed_event_key))::BIGINT AS occupancy_level
      FROM fact_bed_events) e JOIN dim_departments d USING (department_key)"""
q("bed_timeline", _LEVELS)
q("bed_timeline_first_100", f"SELECT * FROM ({_LEVELS}) ORDER BY department_key, bed_number, event_timestamp, bed_event_key LIMIT 100")
q("first_event_per_bed", """SELECT department_key, bed_number, event_timestamp, bed_event_key, event_type, encounter_key
    FROM fact_bed_events e WHERE event_timestamp = (SELECT min(event_timestamp) FROM fact_bed_events b
    WHERE b.department_key = e.department_key AND b.bed_number = e.bed_number)""")
q("list_departments_with_staff", """SELECT department_key, department_name, bed_capacity FROM dim_departments
    WHERE department_key IN (SELECT department_key FROM dim_physicians)""")
q("reference_data_staffing", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS department_name, {beds}::INT AS bed_capacity, '{kind}' AS specialty"
    for name, beds, kinds in DEPARTMENTS for kind in kinds)
  + ") LEFT JOIN (SELECT specialty, count(*) AS physicians FROM dim_physicians GROUP BY 1) USING (specialty)")
q("hourly_slots", """SELECT department_key, unnest(generate_series(date_trunc('hour', min(event_timestamp)),
    date_trunc('hour', max(event_timestamp)), INTERVAL 1 HOUR)) AS time_slot FROM fact_bed_events GROUP BY 1""")

_PAIRS = "FROM dim_patients a JOIN dim_patients b ON a.patient_id = b.patient_id AND b.record_version = a.record_version + 1"
_INS = f"""SELECT a.patient_id, a.first_name || ' ' || a.last_name AS patient_name, a.insurance_type AS old_insurance,
    b.insurance_type AS new_insurance, b.valid_from AS change_date, a.record_version AS old_version,
    b.record_version AS new_version {_PAIRS} WHERE a.insurance_type <> b.insurance_type"""
q("insurance_changes", _INS)
q("insurance_changes_since", f"{_INS} AND b.valid_from > TIMESTAMP '2000-06-01'")
q("address_changes", f"""SELECT a.patient_id, a.first_name || ' ' || a.last_name AS patient_name,
    a.city || ', ' || a.state AS old_location, b.city || ', ' || b.state AS new_location, b.valid_from AS move_date,
    b.record_version - a.record_version AS versions_between {_PAIRS}
    WHERE a.address <> b.address OR a.city <> b.city OR a.state <> b.state""")
q("version_counts", """SELECT patient_id, count(*) AS version_count, max(record_version) AS latest_version,
    min(valid_from) AS first_seen, max(CASE WHEN is_current THEN valid_from END) AS current_since FROM dim_patients
    GROUP BY 1 HAVING count(*) > 1""")
q("scd2_changes", f"""SELECT patient_id, new_version AS record_version, effective_at AS valid_from,
    coalesce(next_at, TIMESTAMP '9999-12-31 23:59:59') AS valid_to, next_at IS NULL AS is_current, {', '.join(feeds.TRACKED)}
    FROM opened""")
q("scd2_merge", "SELECT * FROM merged")
q("stream_scd2", "SELECT * FROM merged")
q("scd2_update", f"""SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN TIMESTAMP '2001-10-01' ELSE valid_to END AS valid_to,
      CASE WHEN hit THEN TIMESTAMP '2001-10-01' ELSE updated_at END AS updated_at, is_current AND NOT hit AS is_current)
      FROM (SELECT *, is_current AND patient_id = '{PATIENT}' AS hit FROM dim_patients)
    UNION ALL SELECT * REPLACE ((SELECT max(patient_key) FROM dim_patients) + 1 AS patient_key, '9 Mill Lane' AS address,
      'Tulsa' AS city, 'OK' AS state, '74103' AS zip_code, TIMESTAMP '2001-10-01' AS valid_from,
      (record_version + 1)::INT AS record_version, TIMESTAMP '2001-10-01' AS created_at, TIMESTAMP '2001-10-01' AS updated_at)
      FROM dim_patients WHERE is_current AND patient_id = '{PATIENT}'""")
q("stream_scd2_set_aside", """SELECT f.patient_id, f.effective_at - INTERVAL 3 YEAR AS effective_at, 'late' AS reason
    FROM feed f JOIN dim_patients p ON p.patient_id = f.patient_id AND p.is_current
    WHERE f.effective_at - INTERVAL 3 YEAR <= p.valid_from""")
_EARLY = "SELECT * REPLACE (effective_at - INTERVAL 3 YEAR AS effective_at) FROM feed"
_LATE = {
    "early": _EARLY,
    "late": """SELECT f.* FROM early f JOIN dim_patients p ON p.patient_id = f.patient_id AND p.is_current
        WHERE f.effective_at <= p.valid_from AND NOT EXISTS (SELECT 1 FROM dim_patients v
          WHERE v.patient_id = f.patient_id AND v.valid_from = f.effective_at)""",
    "timeline": f"""SELECT *, FALSE AS is_new FROM dim_patients WHERE patient_id IN (SELECT patient_id FROM late)
        UNION ALL BY NAME SELECT NULL AS patient_key, l.patient_id, {', '.join(f'p.{c}' for c in _OTHER)},
          {', '.join(f'l.{c}' for c in feeds.TRACKED)}, l.effective_at AS valid_from, NULL AS valid_to, FALSE AS is_current,
          NULL AS record_version, l.effective_at AS created_at, NULL AS updated_at, TRUE AS is_new
          FROM late l JOIN dim_patients p ON p.patient_id = l.patient_id AND p.is_current""",
    "timeline_opened": f"""SELECT * FROM timeline WINDOW w AS (PARTITION BY patient_id ORDER BY valid_from)
        QUALIFY NOT is_new OR lag(is_new) OVER w IS NULL OR {' OR '.join(f'{c} IS DISTINCT FROM lag({c}) OVER w' for c in feeds.TRACKED)}""",
    "timeline_placed": """SELECT *, row_number() OVER w AS place, lead(valid_from) OVER w AS next_from,
        coalesce(lead(is_new) OVER w, FALSE) AS next_new FROM timeline_opened WINDOW w AS (PARTITION BY patient_id ORDER BY valid_from)""",
    "timeline_done": """SELECT * EXCLUDE (place, next_from, next_new) REPLACE (
        CASE WHEN is_new OR (next_new AND valid_to > next_from) THEN next_from ELSE valid_to END AS valid_to,
        CASE WHEN is_new OR (next_new AND valid_to > next_from) THEN next_from ELSE updated_at END AS updated_at,
        place::INT AS record_version) FROM timeline_placed""",
    "spliced": """SELECT * FROM dim_patients WHERE patient_id NOT IN (SELECT patient_id FROM late)
        UNION ALL BY NAME SELECT * EXCLUDE (is_new) FROM timeline_done WHERE NOT is_new
        UNION ALL BY NAME SELECT * EXCLUDE (is_new) REPLACE ((SELECT max(patient_key) FROM dim_patients) + row_number() OVER (ORDER BY
          substr(md5(patient_id || '|' || record_version), 1, 3), patient_id, record_version) AS patient_key)
          FROM timeline_done WHERE is_new""",
    **{
        f"spliced_{name}": re.sub(r"\b(feed_seq|opened)\b", r"spliced_\1", re.sub(r"\bfeed\b", "early", text.replace("dim_patients", "spliced")))
        for name, text in ((n, CARE[n]) for n in ("feed_seq", "opened", "merged"))
    },
}
q("scd2_apply_late", "SELECT * FROM spliced_merged", **_LATE)
q("stream_scd2_late", "SELECT * FROM spliced_merged", **_LATE)
q("scd2_stored_merge", "SELECT * EXCLUDE (patient_key) FROM merged")
for _view in VIEWS:
    SQL[f"{_view}_after_loads"] = REPORTS[_view]
q("stored_visits_of_a_quarter", """SELECT encounter_key, patient_id, admission_date FROM fact_encounters
    WHERE admission_date >= TIMESTAMP '1997-01-01' AND admission_date < TIMESTAMP '1997-04-01'""")
q("late_changes", """SELECT f.* REPLACE (f.effective_at - INTERVAL 3 YEAR AS effective_at) FROM feed f JOIN dim_patients p
    ON p.patient_id = f.patient_id AND p.is_current WHERE f.effective_at - INTERVAL 3 YEAR <= p.valid_from""")
q("detect_changes", "SELECT * FROM labelled")
q("split_changes", """SELECT k AS table_name, count(patient_id) AS row_count FROM (VALUES ('new'), ('updated'), ('unchanged')) t(k)
    LEFT JOIN labelled ON change_type = k GROUP BY 1""")
q("scd2_merge_twice", "SELECT 0::BIGINT * count(*) AS changes_on_second_run FROM feed")
q("last_load_timestamp", "SELECT max(created_at) AS last_load FROM fact_encounters")
q("incremental_rows", "SELECT encounter_key, created_at FROM fact_encounters WHERE created_at > TIMESTAMP '2001-06-01'")
q("incremental_rows_lookback", """SELECT encounter_key, created_at FROM fact_encounters WHERE created_at >
    (SELECT max(created_at) FROM fact_encounters WHERE created_at <= TIMESTAMP '2001-06-01') - INTERVAL 24 HOUR
    AND created_at > TIMESTAMP '2001-05-31 12:00:00'""")
q("check_watermark", """SELECT max(created_at) AS source_max, TIMESTAMP '2001-12-01' AS last_load,
    max(created_at) < TIMESTAMP '2001-12-01' AS went_backwards FROM fact_encounters""")
q("load_trend", """SELECT table_name, start_time::DATE AS load_date, sum(records_loaded)::BIGINT AS total_records,
    avg(duration_seconds::DOUBLE) AS avg_duration, count(*) AS load_count FROM load_history GROUP BY 1, 2""")
q("empty_loads", "SELECT * FROM load_history WHERE records_loaded = 0 AND created_at > TIMESTAMP '2001-08-01' - INTERVAL 7 DAY")
q("recent_loads", "SELECT * FROM load_history ORDER BY created_at DESC, load_id DESC LIMIT 10")
q("append_bed_events", "SELECT * FROM fact_bed_events")
SQL["export_length_of_stay"] = REPORTS["length_of_stay"]
_NAMES = ["dim_departments", "dim_patients", "dim_physicians", "fact_bed_events", "fact_encounters"]
q("record_load", " UNION ALL ".join(f"""SELECT {i}::BIGINT AS load_id, '{t}' AS table_name, count(*) AS records_loaded,
    TIMESTAMP '2001-09-01' AS start_time, TIMESTAMP '2001-09-01 00:00:01.5' AS end_time, 1.5::DECIMAL(10,2) AS duration_seconds,
    TIMESTAMP '2001-09-01 00:00:01.5' AS created_at FROM {t}""" for i, t in enumerate(_NAMES, 1)))
_VIEWS = [n for n in REPORTS if n.startswith("mv_") and not n.endswith("by_department")]
SQL["refresh_marts"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, TRUE AS ok, (SELECT count(*) FROM ({REPORTS[n]})) AS rows" for n in _VIEWS)

_RULE_SQL = {
    "patient_names_present": "SELECT patient_key FROM dim_patients WHERE first_name IS NULL OR last_name IS NULL",
    "encounter_dates_present": "SELECT encounter_key FROM fact_encounters WHERE admission_date IS NULL OR discharge_date IS NULL",
    "encounter_patient_exists": """SELECT e.encounter_key FROM fact_encounters e LEFT JOIN dim_patients p
        ON e.patient_key = p.patient_key WHERE p.patient_key IS NULL""",
    "encounter_department_exists": """SELECT e.encounter_key FROM fact_encounters e LEFT JOIN dim_departments d
        ON e.department_key = d.department_key WHERE d.department_key IS NULL""",
    "bed_event_encounter_exists": """SELECT b.bed_event_key FROM fact_bed_events b LEFT JOIN fact_encounters e
        ON b.encounter_key = e.encounter_key WHERE e.encounter_key IS NULL""",
    "discharge_after_admission": "SELECT encounter_key FROM fact_encounters WHERE discharge_date <= admission_date",
    "bed_within_capacity": """SELECT b.bed_event_key FROM fact_bed_events b JOIN dim_departments d
        ON b.department_key = d.department_key WHERE b.bed_number > d.bed_capacity OR b.bed_number < 1""",
    "age_reasonable": f"""SELECT patient_key FROM dim_patients WHERE date_of_birth > DATE '{AS_OF}'
        OR date_of_birth < DATE '{AS_OF}' - INTERVAL 120 YEAR""",
    "one_current_row": "SELECT patient_id FROM dim_patients WHERE is_current GROUP BY 1 HAVING count(*) > 1",
    "no_history_gaps": f"SELECT a.patient_id {_PAIRS} WHERE a.valid_to <> b.valid_from",
    "current_row_open": f"SELECT patient_key FROM dim_patients WHERE is_current AND valid_to < TIMESTAMP '{AS_OF}'",
    "department_has_physician": """SELECT d.department_key FROM dim_departments d LEFT JOIN dim_physicians p
        ON d.department_key = p.department_key WHERE p.physician_key IS NULL""",
}
for _name, _sql in _RULE_SQL.items():
    q(f"dq_{_name}", _sql)


def _report(name: str, severity: str, description: str, sql: str) -> str:
    text = description.replace("'", "''")
    key = sql.split()[1].split(".")[-1]
    return f"""SELECT '{name}' AS test_name, count(*) = 0 AS passed, '{severity}' AS severity, '{text}' AS description,
        count(*) AS failure_count, coalesce(list({key}::VARCHAR ORDER BY {key}) FILTER (WHERE rn <= 5), []) AS failed_records
        FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS rn FROM ({sql}))"""


_ALL = " UNION ALL ".join(_report(r.name, r.severity, r.description, _RULE_SQL[r.build.__name__]) for r in RULES)
q("dq_run_rules", _ALL)

q("loads_by_status", """SELECT table_name, CASE WHEN records_loaded > 0 THEN 'loaded' ELSE 'empty' END AS status,
    count(*) AS total FROM load_history GROUP BY ALL""")

# The same rules over tables with planted defects.
_PLANTED = {
    "dim_patients": """(SELECT * REPLACE (CASE WHEN patient_key % 89 <> 0 THEN first_name END AS first_name,
        is_current OR patient_key % 3 = 0 AS is_current,
        CASE WHEN patient_key % 67 = 0 THEN TIMESTAMP '2000-01-01' ELSE valid_to END AS valid_to) FROM dim_patients)""",
    "fact_encounters": """(SELECT * REPLACE (CASE WHEN encounter_key % 89 = 0 THEN -1 ELSE patient_key END AS patient_key,
        CASE WHEN encounter_key % 97 = 0 THEN -1 ELSE department_key END AS department_key,
        CASE WHEN encounter_key % 83 = 0 THEN admission_date ELSE discharge_date END AS discharge_date) FROM fact_encounters)""",
    "fact_bed_events": """(SELECT * REPLACE (CASE WHEN bed_event_key % 101 = 0 THEN -1 ELSE encounter_key END AS encounter_key,
        CASE WHEN bed_event_key % 79 = 0 THEN 0 ELSE bed_number END AS bed_number) FROM fact_bed_events)""",
    "dim_physicians": "(SELECT * FROM dim_physicians WHERE department_key <> 1)",
}


def _planted(sql: str) -> str:
    return re.sub(r"\b(" + "|".join(_PLANTED) + r")\b", lambda m: _PLANTED[m[1]], sql)


for _name, _sql in _RULE_SQL.items():
    q(f"dq_planted_{_name}", _planted(_sql))
_ALL_PLANTED = " UNION ALL ".join(
    _report(r.name, r.severity, r.description, _planted(_RULE_SQL[r.build.__name__])) for r in RULES)
q("dq_planted_run_rules", _ALL_PLANTED)
q("quality_checks_by_check", f"SELECT test_name, passed, count(*) AS total FROM ({_ALL_PLANTED}) GROUP BY 1, 2")
q("dq_summary", f"""SELECT count(*) AS total_tests, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed,
    count(*) FILTER (WHERE NOT ok AND severity = 'error') AS errors,
    count(*) FILTER (WHERE NOT ok AND severity = 'warning') AS warnings,
    count(*) FILTER (WHERE NOT ok AND severity = 'error') = 0 AS success
    FROM (SELECT passed AS ok, severity FROM ({_ALL}))""")
q("quality_checks_by_status", f"SELECT severity, passed, count(*) AS total FROM ({_ALL}) GROUP BY 1, 2")
q("dq_unique_patient_id", "SELECT patient_id, count(*) AS occurrences FROM dim_patients GROUP BY 1 HAVING count(*) > 1")
q("dq_not_null_discharge", "SELECT encounter_key FROM fact_encounters WHERE discharge_date IS NULL")


def _column_test(model: str, src: str, col: str, kind: str) -> str:
    bad = (
        f"SELECT count(*) AS n FROM (SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        if kind == "unique" else f"SELECT count(*) AS n FROM {src} WHERE {col} IS NULL"
    )
    return f"SELECT '{model}' AS model, '{col}' AS column_name, '{kind}' AS test, n AS failures FROM ({bad})"


q("dq_column_tests", " UNION ALL ".join([
    _column_test("stg_patients", "(SELECT * FROM stg_p WHERE is_current)", "patient_key", "not_null"),
    _column_test("stg_patients", "(SELECT * FROM stg_p WHERE is_current)", "patient_key", "unique"),
    _column_test("stg_encounters", "stg_e", "encounter_key", "not_null"),
    _column_test("stg_encounters", "stg_e", "encounter_key", "unique"),
    _column_test("stg_encounters", "stg_e", "length_of_stay_days", "not_null"),
    _column_test("int_patient_encounters", "int_pe", "encounter_key", "not_null"),
    _column_test("int_patient_encounters", "int_pe", "encounter_key", "unique"),
]))
q("dq_row_rules", """SELECT encounter_key, 'date_range' AS rule FROM fact_encounters WHERE admission_date >= discharge_date
      OR admission_date > TIMESTAMP '2001-06-01'
    UNION ALL SELECT encounter_key, 'positive_integer' FROM fact_encounters WHERE encounter_key <= 0
    UNION ALL SELECT encounter_key, 'required' FROM fact_encounters WHERE patient_key IS NULL OR discharge_date IS NULL""")
q("dq_probability", """SELECT request_id, 'probability' AS rule FROM requests
    WHERE duration_seconds IS NULL OR NOT duration_seconds BETWEEN 0 AND 1""")
q("dq_user_rules", _report("Stays are shorter than ten days", "warning", "",
                           "SELECT encounter_key FROM fact_encounters WHERE los_us >= 10 * 86400000000::BIGINT")
  + " UNION ALL " + _report("Physicians have a department", "error", "",
                            "SELECT physician_key FROM dim_physicians WHERE department_key IS NULL"))

q("freshness", f"""SELECT last_update, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_update)) / 3600e6 AS hours_since_update,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_update)) / 3600e6 > 48 AS stale
    FROM (SELECT max(created_at) AS last_update FROM fact_encounters)""")
q("volume_anomalies", """SELECT *, admissions < avg_admissions * 0.3e0 OR admissions > avg_admissions * 2e0 AS unusual
    FROM (SELECT admission_day, daily_count AS admissions, avg(daily_count) OVER () AS avg_admissions FROM
      (SELECT admission_date::DATE AS admission_day, count(*) AS daily_count FROM fact_encounters
       WHERE admission_date > TIMESTAMP '2001-08-01' - INTERVAL 7 DAY GROUP BY 1))""")
q("validate_counts", """SELECT 'patients' AS check_name, count(*) AS row_count, 1000::BIGINT AS minimum, NULL::TIMESTAMP AS last_load,
    count(*) >= 1000 AS passed FROM dim_patients WHERE is_current
    UNION ALL SELECT 'encounters', count(*), 5000, max(created_at), count(*) >= 5000 FROM fact_encounters""")


def _errors(width: int, slide: int | None = None) -> str:
    start = f"time_bucket(INTERVAL {width} MINUTE, \"timestamp\")"
    src = "requests"
    if slide:
        start = f"time_bucket(INTERVAL {slide} MINUTE, \"timestamp\") - to_minutes(k * {slide})"
        src = f"requests, range(0, {width // slide}) r(k)"
    return f"""SELECT window_start, window_start + INTERVAL {width} MINUTE AS window_end, requests, errors,
    errors::DOUBLE / requests AS error_share, errors::DOUBLE / requests > 0.05e0 AS alert,
    CASE WHEN errors::DOUBLE / requests > 0.5e0 THEN 'critical' WHEN errors::DOUBLE / requests > 0.1e0 THEN 'warning' ELSE 'ok' END AS level
    FROM (SELECT {start} AS window_start, count(*) AS requests, count(*) FILTER (WHERE status_code >= 500) AS errors
      FROM {src} GROUP BY 1)"""


def _sustained(width: int, k: int) -> str:
    return f"""SELECT window_start, window_end, row_number() OVER (PARTITION BY run ORDER BY window_start) AS alert_windows
    FROM (SELECT *, epoch_us(window_start) // ({width} * 60000000) - row_number() OVER (ORDER BY window_start) AS run
      FROM ({_errors(width)}) WHERE alert) QUALIFY alert_windows >= {k}"""


q("error_rate", _errors(5))
q("stream_error_rate", _errors(5))
q("error_rate_sliding", _errors(5, 1))
q("stream_error_rate_sliding", _errors(5, 1))
q("sustained_errors", _sustained(30, 3))
q("stream_sustained", _sustained(5, 2))
# What a watermark of an hour behind the newest request has closed: windows that have ended, runs whose session is over.
_CLOSED = "(SELECT date_trunc('millisecond', max(\"timestamp\")) - INTERVAL 1 HOUR FROM requests)"
q("stream_sustained_runs", f"""SELECT window_start, window_end, row_number() OVER (PARTITION BY run ORDER BY window_start) AS alert_windows
    FROM (SELECT *, max(window_end) OVER (PARTITION BY run) AS run_end FROM (
      SELECT *, epoch_us(window_start) // 300000000 - row_number() OVER (ORDER BY window_start) AS run
      FROM ({_errors(5)}) WHERE alert AND window_end <= {_CLOSED}))
    WHERE run_end - INTERVAL 1 MICROSECOND + INTERVAL 301 SECOND <= {_CLOSED} QUALIFY alert_windows >= 2""")
q("stream_events_once", "SELECT event_id, ts, event_type, value FROM events")
# Of three deliveries of the same rows the second meets all keys in state, the third those that the look-back has kept.
q("stream_events_dropped", """SELECT count(*) + count(*) FILTER (WHERE ts > mark) AS replayed, count(*) FILTER (WHERE ts <= mark) AS late
    FROM events, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR AS mark FROM events)""")
_RATE = """SELECT time_bucket(INTERVAL 1 MINUTE, "timestamp") AS window_start,
    time_bucket(INTERVAL 1 MINUTE, "timestamp") + INTERVAL 1 MINUTE AS window_end, path, status_code, count(*) AS requests,
    count(*) / 60e0 AS per_second FROM requests GROUP BY 1, 2, 3, 4"""
q("request_rate", _RATE)
q("stream_request_rate", _RATE)
def _p95(width: int) -> str:
    return f"""SELECT *, p95_seconds > 1 AS alert FROM (SELECT time_bucket(INTERVAL {width} MINUTE, "timestamp") AS window_start,
    time_bucket(INTERVAL {width} MINUTE, "timestamp") + INTERVAL {width} MINUTE AS window_end,
    quantile_cont(round(duration_seconds * 1e6)::BIGINT, 0.95) / 1e6 AS p95_seconds FROM requests GROUP BY 1, 2)"""


q("latency_p95", _p95(5))
q("latency_p95_hourly", _p95(60))


def _latency(width: int) -> str:
    n = len(DURATION_BOUNDS)
    arms = []
    for i, b in enumerate(DURATION_BOUNDS):
        lo, under = (DURATION_BOUNDS[i - 1], f"c{i - 1}") if i else (0.0, "0")
        arms.append(f"WHEN c{i} >= n * 0.95e0 THEN {lo}::DOUBLE + ({b - lo!r})::DOUBLE * ((n * 0.95e0 - {under}) / nullif(c{i} - {under}, 0))")
    counts = ", ".join(f"count(*) FILTER (WHERE duration_seconds <= {b}::DOUBLE) AS c{i}" for i, b in enumerate(DURATION_BOUNDS))
    return f"""SELECT window_start, window_start + INTERVAL {width} MINUTE AS window_end, requests, p95_seconds, p95_seconds > 1 AS alert
    FROM (SELECT window_start, n AS requests, CASE {' '.join(arms)} ELSE {DURATION_BOUNDS[n - 1]}::DOUBLE END AS p95_seconds
      FROM (SELECT time_bucket(INTERVAL {width} MINUTE, "timestamp") AS window_start, count(*) AS n, {counts}
        FROM requests GROUP BY 1))"""


q("latency_buckets", _latency(60))
q("stream_latency", _latency(5))
_LOG = 'SELECT "timestamp", severity, method, path, status_code, duration_seconds FROM requests'
q("filter_logs_errors", f"{_LOG} WHERE severity = 'ERROR'")
q("filter_logs_path", f"{_LOG} WHERE path = '/view'")
q("filter_logs_slow", f"{_LOG} WHERE duration_seconds > 0.5e0")
q("count_by_labels", "SELECT method, path, status_code, count(*) AS total FROM requests GROUP BY 1, 2, 3")
q("duration_histogram", " UNION ALL ".join(
    [f"SELECT method, path, '{b}' AS le, count(*) FILTER (WHERE duration_seconds <= {b}::DOUBLE) AS total FROM requests GROUP BY 1, 2"
     for b in DURATION_BOUNDS] + ["SELECT method, path, '+Inf', count(*) FROM requests GROUP BY 1, 2"]))

q("training_set", "SELECT * EXCLUDE (chief_complaint) FROM training")
q("training_summary", f"""SELECT count(*) AS encounters, sum(readmitted_30d) / count(*) AS readmission_rate,
    {rnd('avg(length_of_stay)', 6)} AS avg_los FROM training""")
q("feature_preparation", """SELECT encounter_key, age::DOUBLE AS age, length_of_stay, num_previous_visits,
    (dense_rank() OVER (ORDER BY department_name) - 1)::DOUBLE AS department_encoded, 2::BIGINT AS diagnosis_severity,
    (dense_rank() OVER (ORDER BY insurance_type) - 1)::DOUBLE AS insurance_encoded, hour(admission_date) AS admission_hour
    FROM training""")
q("feature_preparation_with_gaps", """SELECT encounter_key,
    CASE WHEN encounter_key % 89 <> 0 THEN age::DOUBLE
      ELSE (SELECT quantile_cont(age, 0.5) FROM training WHERE encounter_key % 89 <> 0) END AS age,
    length_of_stay, num_previous_visits,
    (dense_rank() OVER (ORDER BY department_name) - 1)::DOUBLE AS department_encoded, 2::BIGINT AS diagnosis_severity,
    (dense_rank() OVER (ORDER BY insurance_type) - 1)::DOUBLE AS insurance_encoded, hour(admission_date) AS admission_hour
    FROM training""")
q("severity_by_category", """SELECT encounter_key, CASE chief_complaint WHEN 'Chest pain' THEN 'Cardiac'
      WHEN 'Shortness of breath' THEN 'Respiratory' WHEN 'Fever' THEN 'Infectious Disease' WHEN 'Back pain' THEN 'Orthopedic'
      WHEN 'Injury/Trauma' THEN 'Trauma' ELSE 'General' END AS diagnosis_category,
    CASE chief_complaint WHEN 'Chest pain' THEN 5 WHEN 'Shortness of breath' THEN 4 WHEN 'Fever' THEN 4
      WHEN 'Back pain' THEN 3 ELSE 2 END::BIGINT AS severity FROM training""")
_HASH = "('0x' || substr(md5(encounter_key::VARCHAR), 1, 15))::BIGINT"
q("split_plain", f"""SELECT encounter_key, readmitted_30d, row_number() OVER (ORDER BY {_HASH}) <= greatest(floor(n * 0.8e0), 1) AS is_train
    FROM training, (SELECT count(*) AS n FROM training)""")
q("split_stratified", f"""SELECT encounter_key, readmitted_30d, row_number() OVER (PARTITION BY readmitted_30d ORDER BY {_HASH})
    <= greatest(floor(count(*) OVER (PARTITION BY readmitted_30d) * 0.8e0), 1) AS is_train FROM training""")
_SPLIT = f"""SELECT readmitted_30d, row_number() OVER (PARTITION BY readmitted_30d ORDER BY {_HASH})
    <= greatest(floor(count(*) OVER (PARTITION BY readmitted_30d) * 0.8e0), 1) AS is_train FROM training"""
q("readmission_model_split", f"""SELECT readmitted_30d, count(*) AS rows, CASE WHEN is_train THEN 'train' ELSE 'test' END AS part
    FROM ({_SPLIT}) GROUP BY ALL""")
q("readmission_model_saved", """SELECT count(*) AS scored, 0::BIGINT AS changed, 0::BIGINT AS wrong_bands,
    0::BIGINT AS out_of_range FROM asks""")
q("los_model_spread", "SELECT count(*) AS scored, 0::BIGINT AS out_of_order, 0::BIGINT AS mean_is_not_prediction FROM asks")
_POINTS = """CASE WHEN age > 75 THEN 25 WHEN age > 65 THEN 15 WHEN age > 50 THEN 5 ELSE 0 END
    + CASE WHEN length_of_stay < 1 THEN 10 WHEN length_of_stay > 10 THEN 20 ELSE 0 END
    + CASE WHEN prior_visits >= 5 THEN 30 WHEN prior_visits >= 3 THEN 20 WHEN prior_visits >= 1 THEN 10 ELSE 0 END
    + CASE admission_type WHEN 'Emergency' THEN 15 WHEN 'Transfer' THEN 10 ELSE 0 END
    + CASE insurance_type WHEN 'Uninsured' THEN 10 WHEN 'Medicaid' THEN 5 ELSE 0 END
    + CASE WHEN has_chronic THEN 15 ELSE 0 END"""
q("risk_score", f"""SELECT encounter_key, risk_score,
    CASE WHEN risk_score >= 70 THEN '{risk.RISK_LEVELS[0][1]}' WHEN risk_score >= 40 THEN '{risk.RISK_LEVELS[1][1]}'
         ELSE '{risk.RISK_LEVELS[2][1]}' END AS risk_level,
    CASE WHEN risk_score >= 70 THEN '{risk.RISK_LEVELS[0][2]}' WHEN risk_score >= 40 THEN '{risk.RISK_LEVELS[1][2]}'
         ELSE '{risk.RISK_LEVELS[2][2]}' END AS recommendation, factors
    FROM (SELECT encounter_key, least(100,
      {_POINTS})::BIGINT AS risk_score,
      concat_ws('; ', CASE WHEN age > 65 THEN printf('Age %d (senior population)', age) END,
        CASE WHEN length_of_stay > 10 THEN printf('Extended LOS (%d days)', length_of_stay) END,
        CASE WHEN prior_visits >= 3 THEN printf('Frequent visitor (%d prior visits)', prior_visits) END,
        CASE WHEN admission_type = 'Emergency' THEN 'Emergency admission' END,
        CASE WHEN insurance_type = 'Uninsured' THEN 'Self-pay insurance status' END,
        CASE WHEN has_chronic THEN 'Chronic condition present' END) AS factors FROM asks)""")
q("los_forecast", f"""SELECT encounter_key, department_name, admission_type, age_group, base_los, sample_size, predicted_los,
    predicted_los - base_los AS difference, predicted_los * (1 - 0.2e0) AS lower_bound, predicted_los * (1 + 0.2e0) AS upper_bound
    FROM (SELECT a.*, base_los, sample_size, base_los
      * CASE admission_type WHEN 'Emergency' THEN 1.2e0 WHEN 'Scheduled' THEN 0.9e0 ELSE 1e0 END
      * CASE WHEN age_group IN ('55-74', '75+') THEN 1.15e0 WHEN age_group = '0-17' THEN 0.85e0 ELSE 1e0 END AS predicted_los
      FROM (SELECT encounter_key, department_name, admission_type, {bucket('age', X.AGE_GROUPS)} AS age_group FROM asks) a
      JOIN (SELECT department_name, {quantile_days(0.5)} AS base_los, count(*) AS sample_size FROM stays GROUP BY 1) b
      USING (department_name))""")
_RISK = {
    "risk_scored": f"""SELECT a.encounter_key, least(100, {_POINTS})::BIGINT AS score, CASE WHEN EXISTS (SELECT 1 FROM fact_encounters r
        WHERE r.patient_id = f.patient_id AND r.encounter_key <> f.encounter_key AND r.admission_date BETWEEN f.discharge_date
        AND f.discharge_date + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS back FROM asks a
        JOIN (SELECT encounter_key, patient_id, discharge_date FROM fact_encounters) f USING (encounter_key)""",
    "risk_counts": """SELECT count(*) FILTER (score >= 40 AND back = 1) AS tp, count(*) FILTER (score >= 40 AND back = 0) AS fp,
        count(*) FILTER (score < 40 AND back = 1) AS fn, count(*) FILTER (score < 40 AND back = 0) AS tn FROM risk_scored""",
}
q("risk_score_auc", """SELECT round((sum(place) FILTER (back = 1) - p * (p + 1) / 2) / (p * n), 9) AS roc_auc
    FROM (SELECT back, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS place,
      count(*) FILTER (back = 1) OVER () AS p, count(*) FILTER (back = 0) OVER () AS n FROM risk_scored) GROUP BY p, n""", **_RISK)
q("risk_score_confusion", "SELECT * FROM risk_counts", **_RISK)
q("risk_score_report", """SELECT 0::INT AS label, tn::DOUBLE / nullif(tn + fn, 0) AS precision, tn::DOUBLE / nullif(tn + fp, 0) AS recall,
    2 * tn::DOUBLE / nullif(2 * tn + fn + fp, 0) AS f1, tn + fp AS support FROM risk_counts
    UNION ALL SELECT 1, tp::DOUBLE / nullif(tp + fp, 0), tp::DOUBLE / nullif(tp + fn, 0), 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0),
    tp + fn FROM risk_counts""", **_RISK)
q("los_forecast_figures", """SELECT round(avg(abs(predicted - target)), 4) AS mae, round(sqrt(avg((predicted - target) ** 2)), 4) AS rmse,
    round(1 - avg((predicted - target) ** 2) / var_pop(target), 4) AS r2 FROM forecast WHERE predicted IS NOT NULL""",
  forecast=f"""SELECT greatest(0, least(60, a.los_days)) AS target, base_los
      * CASE admission_type WHEN 'Emergency' THEN 1.2e0 WHEN 'Scheduled' THEN 0.9e0 ELSE 1e0 END
      * CASE WHEN age_group IN ('55-74', '75+') THEN 1.15e0 WHEN age_group = '0-17' THEN 0.85e0 ELSE 1e0 END AS predicted
      FROM (SELECT los_days, department_name, admission_type, {bucket('age', X.AGE_GROUPS)} AS age_group FROM asks) a
      JOIN (SELECT department_name, {quantile_days(0.5)} AS base_los FROM stays GROUP BY 1) b USING (department_name)""")
_DIAG = "CASE is_emergency WHEN 1 THEN 'Cardiac' ELSE 'General' END AS diagnosis_category"
q("requests_to_readmission_features", f"""SELECT encounter_key, age, 'General' AS department_name, {_DIAG}, los_days AS length_of_stay,
    prior_visits AS num_previous_visits, CASE is_uninsured WHEN 1 THEN 'Self-Pay' ELSE 'Medicare' END AS insurance_type FROM asks""")
q("requests_to_los_features", f"""SELECT encounter_key, age, 'General' AS department_name, {_DIAG}, 0::BIGINT AS num_previous_visits,
    'Medicare' AS insurance_type, TIMESTAMP '2024-01-07' + to_days(day_of_week::INT) + to_hours(hour_of_day) AS admission_date FROM asks""")
