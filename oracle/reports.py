"""SQL of the lookups, reports and windows."""

from __future__ import annotations

from oracle.base import (
    AS_OF, age, bucket, ctype, day_name, mean_days, mean_hours, pct, quantile_days, rnd, total_days, weekday_flag,
    with_star,
)
from wardline.functions import exprs as X
from wardline.plans.lookups import since

D7, D30, D90 = since(7, AS_OF), since(30, AS_OF), since(90, AS_OF)
PATIENT = "Customer#000000025"
ER = "Emergency Department"
SQL: dict[str, str] = {}

EXTRA = {
    "stays": "SELECT e.*, d.department_name FROM fact_encounters e JOIN dim_departments d USING (department_key)",
    "stg_p": f"""SELECT patient_key, patient_id, first_name, last_name,
        coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS full_name, date_of_birth,
        {age('date_of_birth')} AS age,
        {bucket(age('date_of_birth'), X.AGE_GROUPS_STAGING)} AS age_group, gender, address, city, state, zip_code,
        phone_number, insurance_type,
        CASE insurance_type WHEN 'Private' THEN 'Commercial' WHEN 'Private Insurance' THEN 'Commercial'
          WHEN 'Medicare' THEN 'Government' WHEN 'Medicaid' THEN 'Government' WHEN 'Uninsured' THEN 'Self-Pay'
          WHEN 'Self-Pay/Uninsured' THEN 'Self-Pay' END AS insurance_category,
        created_at, updated_at, record_version, is_current FROM dim_patients""",
    "stg_e": f"""SELECT encounter_key, patient_key, patient_id, department_key, physician_key, encounter_id,
        admission_date, discharge_date, admission_date::DATE AS admission_date_only,
        discharge_date::DATE AS discharge_date_only, los AS length_of_stay_days,
        CASE WHEN los < 1 THEN 'Short (0-1 day)' WHEN los BETWEEN 1 AND 3 THEN 'Medium (1-3 days)'
          WHEN los BETWEEN 3 AND 7 THEN 'Extended (3-7 days)' ELSE 'Long (7+ days)' END AS length_of_stay_category,
        admission_type, chief_complaint, NULL::VARCHAR AS discharge_disposition,
        dayofweek(admission_date) AS admission_day_of_week, {day_name('admission_date')} AS admission_day_name,
        {weekday_flag('admission_date')} AS admission_weekday_flag, created_at, los_us FROM fact_encounters""",
    "int_pe": """SELECT e.encounter_key, encounter_id, admission_date, discharge_date, length_of_stay_days,
        length_of_stay_category, admission_type, chief_complaint, discharge_disposition, admission_day_name,
        admission_weekday_flag, p.patient_key, p.patient_id, full_name AS patient_name, age AS patient_age,
        age_group AS patient_age_group, gender AS patient_gender, insurance_type, insurance_category,
        city AS patient_city, state AS patient_state, d.department_key, department_name,
        NULL::VARCHAR AS department_type, ph.physician_key, ph.first_name || ' ' || ph.last_name AS physician_name,
        specialty AS physician_specialty, los_us
        FROM stg_e e JOIN stg_p p USING (patient_key) JOIN dim_departments d ON d.department_key = e.department_key
        JOIN dim_physicians ph ON ph.physician_key = e.physician_key""",
    "months": """SELECT DISTINCT patient_id, date_trunc('month', admission_date) AS visit_month FROM fact_encounters""",
    "cohorts": """SELECT m.patient_id, visit_month, f.cohort_month,
        (year(visit_month) - year(f.cohort_month)) * 12 + month(visit_month) - month(f.cohort_month) AS idx
        FROM months m JOIN (SELECT patient_id, min(visit_month) AS cohort_month FROM months GROUP BY 1) f
        USING (patient_id)""",
    "daily": "SELECT admission_date::DATE AS admission_day, count(*) AS daily_count FROM fact_encounters GROUP BY 1",
    "next_visit": """SELECT *, lead(admission_date) OVER w AS next_admission, lead(encounter_key) OVER w AS next_key,
        lead(department_key) OVER w AS next_department FROM fact_encounters
        WINDOW w AS (PARTITION BY patient_id ORDER BY admission_date, encounter_key)""",
}


def q(name: str, body: str, **extra: str) -> None:
    SQL[name] = with_star(body, {**EXTRA, **extra})


_TABLES = {"dim_patients": 18, "dim_departments": 5, "dim_physicians": 7, "fact_encounters": 11, "fact_bed_events": 7}
q("table_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {n}::BIGINT AS column_count FROM {t}" for t, n in _TABLES.items()))
q("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES))
q("encounters_to_bed_events", "SELECT * FROM fact_bed_events")
q("scan_dim_patients", "SELECT * FROM dim_patients")
q("scan_dim_physicians", "SELECT * FROM dim_physicians")
q("scan_fact_encounters", "SELECT * EXCLUDE (los_us, los) FROM fact_encounters")
q("run_sql_department_period",
  f"SELECT encounter_key, admission_date FROM stays WHERE department_name = '{ER}' AND admission_date >= TIMESTAMP '{D90}'")
q("upsert_latest_visit", """SELECT patient_id, admission_date, encounter_key FROM fact_encounters o
    WHERE admission_date < TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM fact_encounters n
      WHERE n.patient_id = o.patient_id AND n.admission_date >= TIMESTAMP '1998-01-01')
    UNION ALL SELECT patient_id, admission_date, encounter_key FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
      ORDER BY admission_date DESC, encounter_key DESC) AS rn FROM fact_encounters
      WHERE admission_date >= TIMESTAMP '1998-01-01') WHERE rn = 1""")
q("build_graph_visits_by_specialty",
  "SELECT physician_specialty, insurance_category, count(*) AS encounters FROM int_pe GROUP BY 1, 2")

_CARD = "patient_id, first_name, last_name, date_of_birth, gender, insurance_type, city, state"
q("current_patients", """SELECT patient_id, first_name, last_name, address, city, state, zip_code, insurance_type,
    valid_from, valid_to, record_version FROM dim_patients WHERE is_current
    ORDER BY last_name, first_name, patient_id LIMIT 20""")
q("patients_as_of", """SELECT patient_id, first_name, last_name, address, city, state, insurance_type, valid_from,
    valid_to, record_version FROM dim_patients
    WHERE valid_from <= TIMESTAMP '1999-06-01' AND valid_to > TIMESTAMP '1999-06-01'""")
q("patients_as_of_relation", """SELECT patient_id, record_version, valid_from, valid_to FROM dim_patients p,
    (SELECT max(admission_date) AS at FROM fact_encounters) t WHERE p.valid_from <= t.at AND p.valid_to > t.at""")
q("patient_history", f"""SELECT patient_key, patient_id, address, city, state, zip_code, insurance_type, valid_from,
    valid_to, is_current, record_version, (epoch_us(valid_to) - epoch_us(valid_from)) // 1000000 / 86400e0 AS days_active
    FROM dim_patients WHERE patient_id = '{PATIENT}'""")
q("get_current", f"SELECT {_CARD} FROM dim_patients WHERE patient_id = '{PATIENT}' AND is_current")
q("list_patients", f"SELECT {_CARD} FROM dim_patients WHERE is_current ORDER BY patient_id LIMIT 100 OFFSET 40")
_ENC = "encounter_key, patient_id, admission_date, discharge_date, admission_type, department_name, chief_complaint"
q("list_encounters", f"SELECT {_ENC} FROM stays ORDER BY admission_date DESC, encounter_key LIMIT 100")
q("list_encounters_of_patient",
  f"SELECT {_ENC} FROM stays WHERE patient_id = '{PATIENT}' ORDER BY admission_date DESC, encounter_key LIMIT 100")
q("search_patients", f"""SELECT patient_id, first_name || ' ' || last_name AS name, {age('date_of_birth')} AS age, gender,
    insurance_type, city || ', ' || state AS location FROM dim_patients
    WHERE is_current AND (contains(lower(first_name), 'ar') OR contains(lower(last_name), 'ar'))
    ORDER BY last_name, first_name, patient_id LIMIT 50""")
q("patient_encounters", f"""SELECT admission_date, discharge_date, department_name, admission_type, chief_complaint,
    {rnd('los', 1)} AS los_days FROM stays WHERE patient_id = '{PATIENT}'""")
q("trailing_90d", f"SELECT encounter_key, admission_date FROM fact_encounters WHERE admission_date >= TIMESTAMP '{D90}'")
q("stg_patients", "SELECT * EXCLUDE (is_current) FROM stg_p WHERE is_current")
q("stg_encounters", "SELECT * EXCLUDE (los_us) FROM stg_e")
q("patient_by_first_key", f"""SELECT {_CARD} FROM dim_patients
    WHERE is_current AND patient_id = (SELECT patient_id FROM dim_patients ORDER BY patient_id LIMIT 1)""")
q("los_values", "SELECT encounter_key, los AS los_days FROM fact_encounters WHERE los <= 30")
q("los_values_department", f"SELECT encounter_key, los AS los_days FROM stays WHERE los <= 30 AND department_name = '{ER}'")
q("has_encounters", f"SELECT EXISTS (SELECT 1 FROM fact_encounters WHERE patient_id = '{PATIENT}') AS has_encounters")
q("int_patient_encounters", "SELECT * EXCLUDE (los_us) FROM int_pe")

q("length_of_stay", f"""SELECT department_name, admission_type, count(*) AS num_encounters,
    {rnd(mean_days(), 2)} AS avg_los_days, {rnd('min(los)', 2)} AS min_los_days, {rnd('max(los)', 2)} AS max_los_days,
    {rnd(quantile_days(0.5), 2)} AS median_los_days FROM stays GROUP BY 1, 2""")
q("daily_volume", """SELECT admission_date::DATE AS admission_date, department_name, admission_type,
    count(*) AS num_encounters, count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY stays.admission_date::DATE) AS pct_of_daily_total
    FROM stays GROUP BY stays.admission_date::DATE, department_name, admission_type""")
q("er_wait_times", f"""SELECT admission_date::DATE AS encounter_date, hour(admission_date) AS encounter_hour,
    count(*) AS num_encounters, {rnd(mean_hours(), 2)} AS avg_wait_hours, {rnd('min(los_us) / 3600e6', 2)} AS min_wait_hours,
    {rnd('max(los_us) / 3600e6', 2)} AS max_wait_hours,
    {rnd('quantile_cont(los_us, 0.5) / 3600e6', 2)} AS median_wait_hours,
    {rnd('quantile_cont(los_us, 0.95) / 3600e6', 2)} AS p95_wait_hours
    FROM stays WHERE department_name = '{ER}' GROUP BY 1, 2""")
q("department_ranking", f"""SELECT department_name, total_encounters, {rnd('avg_los', 2)} AS avg_length_of_stay_days,
    {rnd('median_los', 2)} AS median_length_of_stay_days, {rnd('stddev_los', 2)} AS stddev_length_of_stay,
    rank() OVER (ORDER BY avg_los) AS los_rank, percent_rank() OVER (ORDER BY avg_los) AS los_percentile,
    ntile(4) OVER (ORDER BY avg_los, department_name) AS los_quartile,
    CASE WHEN percent_rank() OVER (ORDER BY avg_los) < 0.25 THEN 'Top Performer'
         WHEN percent_rank() OVER (ORDER BY avg_los) < 0.75 THEN 'Average' ELSE 'Needs Improvement' END AS performance_category
    FROM (SELECT department_name, count(*) AS total_encounters, {mean_days()} AS avg_los,
      {quantile_days(0.5)} AS median_los, stddev_samp(los) AS stddev_los FROM stays GROUP BY 1)""")
q("physician_utilization", f"""SELECT physician_key, physician_name, specialty, department_name, total_encounters,
    unique_patients, {rnd('total_encounters::DOUBLE / unique_patients', 2)} AS encounters_per_patient,
    {rnd('avg_los', 2)} AS avg_length_of_stay, active_days,
    {rnd('total_encounters::DOUBLE / nullif(active_days, 0)', 2)} AS encounters_per_active_day,
    percent_rank() OVER (PARTITION BY specialty ORDER BY total_encounters) AS workload_percentile_in_specialty,
    CASE WHEN total_encounters > avg(total_encounters) OVER (PARTITION BY specialty) * 1.5e0 THEN 'High Utilization'
         WHEN total_encounters > avg(total_encounters) OVER (PARTITION BY specialty) * 0.5e0 THEN 'Normal Utilization'
         ELSE 'Low Utilization' END AS utilization_category
    FROM (SELECT ph.physician_key, ph.first_name || ' ' || ph.last_name AS physician_name, ph.specialty, d.department_name,
      count(DISTINCT e.encounter_key) AS total_encounters, count(DISTINCT e.patient_key) AS unique_patients,
      {mean_days()} AS avg_los, count(DISTINCT e.admission_date::DATE) AS active_days
      FROM dim_physicians ph JOIN fact_encounters e ON ph.physician_key = e.physician_key
      JOIN dim_departments d ON ph.department_key = d.department_key GROUP BY 1, 2, 3, 4)""")


def _retention(idx: str) -> str:
    counts = ", ".join(f"count(DISTINCT CASE WHEN {idx} = {m} THEN patient_id END) AS m{m}" for m in range(4))
    return (
        "SELECT cohort_month, m0 AS month_0_patients, m1 AS month_1_patients, m2 AS month_2_patients, m3 AS month_3_patients, "
        + ", ".join(f"{pct(f'm{m}', 'm0')} AS month_{m}_retention_pct" for m in (1, 2, 3))
        + f" FROM (SELECT cohort_month, {counts} FROM cohorts GROUP BY 1) ORDER BY cohort_month DESC LIMIT 12"
    )


q("cohort_retention", _retention("idx"))
q("cohort_retention_wrapped", _retention("idx % 12"))
q("cohort_pivot", "SELECT cohort_month, m0 AS month_0, m1 AS month_1, m2 AS month_2, m3 AS month_3, "
  + ", ".join(rnd(f"coalesce(m{m}::DOUBLE / m0 * 100, 0)", 1) + f" AS retention_month_{m}" for m in (1, 2, 3))
  + " FROM (SELECT cohort_month, " + ", ".join(f"max(CASE WHEN idx = {m} THEN n END) AS m{m}" for m in range(4))
  + """ FROM (SELECT cohort_month, visit_month, idx, count(DISTINCT patient_id) AS n FROM cohorts GROUP BY 1, 2, 3)
    WHERE idx <= 3 GROUP BY 1) ORDER BY cohort_month DESC LIMIT 12""")


def _snapshot(bed: str) -> str:
    return f"""SELECT coalesce(e.d, b.d) AS metric_date, coalesce(n, 0) AS total_admissions,
    coalesce(pats, 0) AS unique_patients, {rnd('coalesce(avg_los, 0)', 2)} AS avg_length_of_stay,
    coalesce(em, 0) AS emergency_admissions, coalesce(sc, 0) AS scheduled_admissions,
    coalesce(ba, 0) AS beds_assigned, coalesce(br, 0) AS beds_released,
    {pct('coalesce(em, 0)', 'coalesce(n, 0)')} AS emergency_pct, dayofweek(coalesce(e.d, b.d)) AS day_of_week,
    {weekday_flag('coalesce(e.d, b.d)')} AS weekday_flag
    FROM (SELECT admission_date::DATE AS d, count(*) AS n, count(DISTINCT patient_key) AS pats, {mean_days()} AS avg_los,
      {ctype('Emergency')} AS em, {ctype('Scheduled')} AS sc FROM fact_encounters GROUP BY 1) e
    FULL JOIN (SELECT event_timestamp::DATE AS d,
      count(DISTINCT CASE WHEN event_type = 'bed_assigned' THEN {bed} END) AS ba,
      count(DISTINCT CASE WHEN event_type = 'bed_discharged' THEN {bed} END) AS br FROM fact_bed_events GROUP BY 1) b
    ON e.d = b.d"""


_SNAP = _snapshot("bed_number")
q("mv_daily_hospital_snapshot", _SNAP)
q("mv_daily_hospital_snapshot_by_department", _snapshot("department_key * 1000 + bed_number"))
_PERF = f"""SELECT d.department_key, department_name, bed_capacity, coalesce(staff, 0) AS physician_count,
    n AS total_encounters, pats AS unique_patients, {rnd('avg_los', 2)} AS avg_length_of_stay,
    {rnd('median_los', 2)} AS median_length_of_stay, em AS emergency_count, dis AS discharged_count,
    coalesce(beds, 0) AS unique_beds_used, {pct('coalesce(beds, 0)', 'bed_capacity')} AS bed_utilization_pct,
    {rnd('n::DOUBLE / nullif(coalesce(staff, 0), 0)', 2)} AS encounters_per_physician,
    {pct('em', 'n')} AS emergency_pct, {pct('dis', 'n')} AS discharge_pct
    FROM (SELECT d.department_key, department_name, bed_capacity, count(encounter_key) AS n,
      count(DISTINCT patient_key) AS pats, {mean_days()} AS avg_los, {quantile_days(0.5)} AS median_los,
      {ctype('Emergency')} AS em, count(discharge_date) AS dis
      FROM dim_departments d LEFT JOIN fact_encounters e ON d.department_key = e.department_key GROUP BY 1, 2, 3) d
    LEFT JOIN (SELECT department_key, count(DISTINCT bed_number) AS beds FROM fact_bed_events GROUP BY 1) b
      ON b.department_key = d.department_key
    LEFT JOIN (SELECT department_key, count(*) AS staff FROM dim_physicians GROUP BY 1) p
      ON p.department_key = d.department_key"""
q("mv_department_performance", _PERF)
_DEMO = f"""SELECT age_group, gender, insurance_type, state, patient_count,
    {pct('patient_count', 'sum(patient_count) OVER ()')} AS pct_of_total_patients,
    {pct('patient_count', 'sum(patient_count) OVER (PARTITION BY age_group)')} AS pct_within_age_group
    FROM (SELECT {bucket(age('date_of_birth'), X.AGE_GROUPS_LONG)} AS age_group, gender, insurance_type, state,
      count(*) AS patient_count FROM dim_patients WHERE is_current GROUP BY 1, 2, 3, 4)"""
q("mv_patient_demographics", _DEMO)
_WEEK = f"""SELECT week_start, week_start + INTERVAL 6 DAY AS week_end, n AS weekly_admissions, pats AS unique_patients,
    {rnd('avg_los', 2)} AS avg_length_of_stay, em AS emergency_admissions, sc AS scheduled_admissions,
    {pct('em', 'n')} AS emergency_pct, n - lag(n) OVER (ORDER BY week_start) AS wow_admissions_change,
    {pct('n - lag(n) OVER (ORDER BY week_start)', 'lag(n) OVER (ORDER BY week_start)')} AS wow_admissions_pct_change
    FROM (SELECT date_trunc('week', admission_date)::TIMESTAMP AS week_start, count(*) AS n,
      count(DISTINCT patient_key) AS pats, {mean_days()} AS avg_los, {ctype('Emergency')} AS em,
      {ctype('Scheduled')} AS sc FROM fact_encounters GROUP BY 1)"""
q("mv_weekly_trends", _WEEK)
_COMPL = f"""SELECT chief_complaint, count(*) AS encounter_count, count(DISTINCT patient_key) AS unique_patients,
    {rnd(mean_days(), 2)} AS avg_los_days, {ctype('Emergency')} AS emergency_count,
    {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_total_encounters,
    rank() OVER (ORDER BY count(*) DESC) AS complaint_rank
    FROM fact_encounters GROUP BY 1 ORDER BY encounter_count DESC, chief_complaint LIMIT 20"""
q("mv_top_complaints", _COMPL)
q("mart_encounter_summary", f"""SELECT date_trunc('day', admission_date)::TIMESTAMP AS encounter_date,
    date_trunc('week', admission_date)::TIMESTAMP AS encounter_week,
    date_trunc('month', admission_date)::TIMESTAMP AS encounter_month, department_name, admission_type, patient_age_group,
    insurance_category, admission_weekday_flag, count(*) AS encounter_count, count(DISTINCT patient_key) AS unique_patients,
    {mean_days()} AS avg_length_of_stay, {quantile_days(0.5)} AS median_length_of_stay,
    min(length_of_stay_days) AS min_length_of_stay, max(length_of_stay_days) AS max_length_of_stay,
    sum(CASE WHEN admission_type = 'Emergency' THEN 1 ELSE 0 END)::BIGINT AS emergency_count,
    sum(CASE WHEN admission_type = 'Scheduled' THEN 1 ELSE 0 END)::BIGINT AS scheduled_count,
    sum(CASE WHEN admission_type = 'Transfer' THEN 1 ELSE 0 END)::BIGINT AS transfer_count
    FROM int_pe GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
q("mart_patient_summary", f"""SELECT patient_key, patient_id, patient_name, patient_age, patient_age_group, patient_gender,
    insurance_type, insurance_category, patient_city, patient_state, count(*) AS total_encounters,
    count(DISTINCT department_key) AS departments_visited, min(admission_date) AS first_encounter_date,
    max(admission_date) AS last_encounter_date, {total_days()} AS total_days_hospitalized,
    {mean_days()} AS avg_length_of_stay, max(length_of_stay_days) AS max_length_of_stay,
    sum(CASE WHEN admission_type = 'Emergency' THEN 1 ELSE 0 END)::BIGINT AS emergency_visits,
    sum(CASE WHEN admission_type = 'Scheduled' THEN 1 ELSE 0 END)::BIGINT AS scheduled_visits,
    sum(CASE WHEN admission_type = 'Transfer' THEN 1 ELSE 0 END)::BIGINT AS transfer_visits,
    count(*) >= 3 AS is_frequent_patient, max(admission_date) > TIMESTAMP '{D30}' AS recent_visit_30d
    FROM int_pe GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""")
q("type_breakdown", """SELECT admission_date::DATE AS admission_day,
    sum(CASE WHEN admission_type = 'Emergency' THEN 1 ELSE 0 END)::BIGINT AS emergency,
    sum(CASE WHEN admission_type = 'Scheduled' THEN 1 ELSE 0 END)::BIGINT AS scheduled,
    sum(CASE WHEN admission_type = 'Transfer' THEN 1 ELSE 0 END)::BIGINT AS transfer FROM fact_encounters GROUP BY 1""")
q("read_mv_daily_hospital_snapshot",
  f"SELECT * FROM ({_SNAP}) WHERE metric_date > DATE '{AS_OF}' - 30")
q("read_mv_department_performance", f"SELECT department_name, bed_utilization_pct, total_encounters FROM ({_PERF})")
q("read_mv_patient_demographics", f"SELECT age_group, insurance_type, patient_count FROM ({_DEMO})")
q("read_mv_weekly_trends", f"""SELECT week_start, weekly_admissions, wow_admissions_pct_change FROM ({_WEEK})
    ORDER BY week_start DESC LIMIT 12""")
q("read_mv_top_complaints", f"""SELECT complaint_rank, chief_complaint, encounter_count, emergency_count FROM ({_COMPL})
    ORDER BY complaint_rank, chief_complaint LIMIT 10""")

_CURRENT = "(SELECT count(*) FROM dim_patients WHERE is_current)"
q("summary_stats", f"""SELECT {_CURRENT} AS total_patients, (SELECT count(*) FROM fact_encounters) AS total_encounters,
    (SELECT count(*) FROM dim_departments) AS total_departments, (SELECT count(*) FROM dim_physicians) AS total_physicians,
    (SELECT {rnd(mean_days(), 2)} FROM fact_encounters) AS avg_los_days""")
q("gauges", f"""SELECT 'active_patients' AS metric, {_CURRENT}::DOUBLE AS value
    UNION ALL SELECT 'total_encounters', count(*)::DOUBLE FROM fact_encounters
    UNION ALL SELECT 'avg_length_of_stay', {mean_days()} FROM fact_encounters""")
q("home_kpis", f"""SELECT {_CURRENT} AS total_patients, (SELECT count(*) FROM fact_encounters) AS total_encounters,
    (SELECT max(created_at) FROM fact_encounters) AS last_update, (SELECT count(*) FROM dim_departments) AS total_departments,
    (SELECT count(DISTINCT bed_number) FROM fact_bed_events WHERE event_type = 'bed_assigned') AS active_beds""")
q("operations_kpis", f"""SELECT *, coalesce(assigned_beds::DOUBLE / nullif(total_beds, 0) * 100, 0) AS bed_util_pct
    FROM (SELECT count(*) AS total_admissions, coalesce({mean_days()}, 0) AS avg_los,
      coalesce({ctype('Emergency')}::DOUBLE / nullif(count(*), 0) * 100, 0) AS emergency_pct
      FROM fact_encounters WHERE admission_date >= TIMESTAMP '{D90}'),
    (SELECT count(DISTINCT bed_number) AS assigned_beds FROM fact_bed_events WHERE event_type = 'bed_assigned'),
    (SELECT sum(bed_capacity)::BIGINT AS total_beds FROM dim_departments)""")
_P90 = f"WHERE admission_date >= TIMESTAMP '{D90}'"
_ER90 = f"{_P90} AND department_name = '{ER}'"
q("daily_admissions", f"""SELECT admission_date::DATE AS admission_day, count(*) AS admissions, {ctype('Emergency')} AS emergency,
    {ctype('Scheduled')} AS scheduled FROM fact_encounters {_P90} GROUP BY 1""")
q("admission_types", "SELECT admission_type, count(*) AS admissions FROM fact_encounters GROUP BY 1")
q("admission_types_department", f"SELECT admission_type, count(*) AS admissions FROM stays {_ER90} GROUP BY 1")
q("los_distribution",
  f"SELECT {bucket('los', X.LOS_BUCKETS)} AS los_category, count(*) AS encounters FROM fact_encounters {_P90} GROUP BY 1")
q("hourly_pattern", "SELECT hour(admission_date) AS hour, count(*) AS admissions FROM fact_encounters GROUP BY 1")
q("hourly_pattern_period", f"SELECT hour(admission_date) AS hour, count(*) AS admissions FROM fact_encounters {_P90} GROUP BY 1")
q("dow_pattern", f"""SELECT dayofweek(admission_date) AS dow, {day_name('admission_date')} AS day_name, count(*) AS admissions
    FROM fact_encounters GROUP BY 1, 2""")
q("weekly_trend", f"""SELECT date_trunc('week', admission_date)::TIMESTAMP AS week_start, count(*) AS admissions,
    {mean_days()} AS avg_los FROM fact_encounters WHERE admission_date > TIMESTAMP '{D90}' GROUP BY 1""")
q("los_summary", f"""SELECT *, q3_los - q1_los AS iqr_los FROM (SELECT {mean_days()} AS mean_los,
    {rnd('stddev_samp(los)', 6)} AS stddev_los, min(los) AS min_los, max(los) AS max_los, {quantile_days(0.25)} AS q1_los,
    {quantile_days(0.5)} AS median_los, {quantile_days(0.75)} AS q3_los FROM fact_encounters)""")


def _histogram(rows: str, bins: int) -> str:
    return f"""SELECT least(floor(los / (30e0 / {bins}))::BIGINT + 1, {bins}) AS bin,
    (least(floor(los / (30e0 / {bins}))::BIGINT + 1, {bins}) - 1) * (30e0 / {bins}) AS bin_start, count(*) AS encounters,
    (SELECT {mean_days()} FROM ({rows})) AS mean_los, (SELECT {quantile_days(0.5)} FROM ({rows})) AS median_los
    FROM ({rows}) GROUP BY 1, 2"""


q("los_histogram", _histogram("SELECT * FROM fact_encounters WHERE los <= 30", 50))
q("los_histogram_department", _histogram(f"SELECT * FROM stays WHERE los <= 30 AND department_name = '{ER}'", 30))
q("patient_distribution_gender", "SELECT gender, count(*) AS patients FROM dim_patients WHERE is_current GROUP BY 1")
q("patient_distribution_insurance", "SELECT insurance_type, count(*) AS patients FROM dim_patients WHERE is_current GROUP BY 1")
q("patient_distribution_state", """SELECT state, count(*) AS patients FROM dim_patients WHERE is_current GROUP BY 1
    ORDER BY patients DESC, state LIMIT 10""")
q("patient_kpis", f"""SELECT total_patients, avg_age, g.gender AS most_common_gender, i.insurance_type AS most_common_insurance,
    g.n::DOUBLE / total_patients * 100 AS gender_pct
    FROM (SELECT count(*) AS total_patients, avg({age('date_of_birth')}) AS avg_age FROM dim_patients WHERE is_current),
    (SELECT gender, count(*) AS n FROM dim_patients WHERE is_current GROUP BY 1 ORDER BY n DESC, gender LIMIT 1) g,
    (SELECT insurance_type, count(*) AS n FROM dim_patients WHERE is_current GROUP BY 1 ORDER BY n DESC, insurance_type LIMIT 1) i""")
q("age_distribution", f"""SELECT {bucket(age('date_of_birth'), X.AGE_GROUPS)} AS age_group, count(*) AS patients
    FROM dim_patients WHERE is_current GROUP BY 1""")
q("department_volume", f"""SELECT department_name, count(encounter_key) AS encounters FROM dim_departments d
    LEFT JOIN fact_encounters e ON d.department_key = e.department_key AND admission_date >= TIMESTAMP '{D30}' GROUP BY 1""")
_DEPT90 = f"""SELECT d.department_key, department_name, bed_capacity, count(encounter_key) AS total_encounters,
    {rnd(mean_days(), 1)} AS avg_los, {ctype('Emergency')} AS emergency_count, min(admission_date) AS first_encounter,
    max(admission_date) AS last_encounter, {quantile_days(0.5)} AS median_los,
    {pct(ctype('Emergency'), 'count(encounter_key)', 1)} AS emergency_pct,
    (SELECT count(*) FROM dim_physicians p WHERE p.department_key = d.department_key) AS physician_count
    FROM dim_departments d LEFT JOIN fact_encounters e ON d.department_key = e.department_key
    AND admission_date >= TIMESTAMP '{D90}' GROUP BY 1, 2, 3"""
q("department_comparison", f"""SELECT department_key, department_name, bed_capacity, total_encounters, avg_los, emergency_count,
    emergency_pct, physician_count, total_encounters::DOUBLE / greatest(physician_count, 1) AS encounters_per_physician,
    sum(total_encounters) OVER ()::BIGINT AS all_encounters, {rnd('avg(avg_los) OVER ()', 4)} AS avg_los_all,
    sum(bed_capacity) OVER ()::BIGINT AS total_capacity, sum(physician_count) OVER ()::BIGINT AS total_physicians
    FROM ({_DEPT90})""")
q("department_details", f"SELECT department_name, total_encounters, avg_los, emergency_count, emergency_pct FROM ({_DEPT90})")
q("department_detail", f"""SELECT bed_capacity, total_encounters, avg_los, median_los, first_encounter, last_encounter,
    physician_count FROM ({_DEPT90}) WHERE department_name = '{ER}'""")
q("department_daily", f"SELECT admission_date::DATE AS admission_day, count(*) AS admissions FROM stays {_ER90} GROUP BY 1")
q("department_complaints", f"""SELECT chief_complaint, count(*) AS encounters FROM stays {_ER90} GROUP BY 1
    ORDER BY encounters DESC, chief_complaint LIMIT 10""")
q("frequent_patients", f"""SELECT p.patient_id, first_name || ' ' || last_name AS patient_name,
    count(e.encounter_key) AS visit_count, {rnd(mean_days(), 1)} AS avg_los
    FROM dim_patients p JOIN fact_encounters e ON p.patient_id = e.patient_id WHERE is_current GROUP BY 1, 2
    HAVING count(e.encounter_key) >= 2 ORDER BY visit_count DESC, p.patient_id LIMIT 10""")
q("visit_frequency", f"""SELECT {bucket('visits', X.VISIT_BUCKETS)} AS visit_category, count(*) AS patient_count
    FROM (SELECT p.patient_key, count(e.encounter_key) AS visits FROM dim_patients p
      LEFT JOIN fact_encounters e ON p.patient_id = e.patient_id WHERE is_current GROUP BY 1) GROUP BY 1""")
q("monthly_readmissions", f"""SELECT *, {rnd('avg(readmission_rate) OVER ()', 4)} AS avg_rate,
    sum(readmissions_30d) OVER ()::BIGINT AS total_readmissions FROM (
    SELECT date_trunc('month', discharge_date)::TIMESTAMP AS month, count(*) AS total_discharges,
      count(CASE WHEN next_admission - discharge_date <= INTERVAL 30 DAY THEN 1 END) AS readmissions_30d,
      {pct('count(CASE WHEN next_admission - discharge_date <= INTERVAL 30 DAY THEN 1 END)', 'count(*)', 1)} AS readmission_rate
    FROM next_visit WHERE discharge_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12)""")
q("los_baseline", f"""SELECT department_name, {mean_days()} AS avg_los, {quantile_days(0.5)} AS median_los,
    count(encounter_key) AS sample_size FROM dim_departments d LEFT JOIN fact_encounters e
    ON d.department_key = e.department_key GROUP BY 1 HAVING count(encounter_key) > 0""")
q("bench_current_patients", "SELECT * FROM dim_patients WHERE is_current ORDER BY patient_key LIMIT 100")
q("bench_er_count", f"SELECT count(*) AS er_encounters FROM stays WHERE department_name = '{ER}'")
q("bench_bed_events", f"""SELECT department_key, count(*) AS events FROM fact_bed_events
    WHERE event_timestamp > TIMESTAMP '{D7}' GROUP BY 1""")


def _readm(extra: str) -> str:
    return f"""SELECT n.patient_id, first_name || ' ' || last_name AS patient_name, encounter_key AS initial_encounter,
    discharge_date AS initial_discharge, next_key AS readmission_encounter, next_admission AS readmission_date,
    (epoch_us(next_admission) - epoch_us(discharge_date)) / 86400e6 AS days_to_readmission, d.department_name
    FROM next_visit n JOIN dim_patients p ON p.patient_id = n.patient_id AND p.is_current
    JOIN dim_departments d ON d.department_key = n.next_department
    WHERE next_admission - discharge_date <= INTERVAL 30 DAY {extra}"""


q("readmissions", _readm(""))
q("readmissions_without_overlap", _readm("AND next_admission >= discharge_date"))
_RUN = f"""SELECT admission_day, daily_count, (sum(daily_count) OVER (ORDER BY admission_day
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cumulative_admissions,
    avg(daily_count) OVER (ORDER BY admission_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg_7day,
    daily_count - lag(daily_count) OVER (ORDER BY admission_day) AS day_over_day_change,
    {pct('daily_count - lag(daily_count) OVER (ORDER BY admission_day)', 'lag(daily_count) OVER (ORDER BY admission_day)')}
      AS day_over_day_pct_change FROM daily"""
q("daily_running", f"{_RUN} ORDER BY admission_day DESC LIMIT 30")
q("daily_running_all", _RUN)
q("centred_average", """SELECT admission_day, daily_count, avg(daily_count) OVER (ORDER BY admission_day
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS centred_avg FROM daily""")
q("prior_visits", """SELECT patient_id, encounter_key, admission_date, count(*) OVER (PARTITION BY patient_id
    ORDER BY admission_date, encounter_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS num_previous_visits
    FROM fact_encounters""")
q("encounter_sequence", """SELECT patient_id, encounter_key, admission_date,
    row_number() OVER (PARTITION BY patient_id ORDER BY admission_date, encounter_key) AS visit_number,
    dense_rank() OVER (PARTITION BY patient_id ORDER BY admission_date) AS visit_rank FROM fact_encounters""")
q("trailing_7d_visits", """SELECT patient_id, encounter_key, admission_date, count(*) OVER (PARTITION BY patient_id
    ORDER BY admission_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS visits_7d FROM fact_encounters""")
q("recursive_month_calendar", """SELECT m.month_start::DATE AS month_start, count(encounter_key) AS admissions
    FROM (SELECT unnest(generate_series(date_trunc('month', min(admission_date)), date_trunc('month', max(admission_date)),
      INTERVAL 1 MONTH)) AS month_start FROM fact_encounters) m
    LEFT JOIN fact_encounters e ON date_trunc('month', e.admission_date) = m.month_start GROUP BY 1""")

q("order_pg_open_stays", "SELECT encounter_key, discharge_date FROM fact_encounters")
q("order_by_bucket_los", "SELECT length_of_stay_category, count(*) AS encounters FROM stg_e GROUP BY 1")
q("top_k_longest_stays", """SELECT encounter_key, los_us FROM fact_encounters WHERE los_us IS NOT NULL
    ORDER BY los_us DESC, encounter_key LIMIT 25""")
q("page_encounters", "SELECT encounter_key, admission_date FROM fact_encounters ORDER BY 2, 1 LIMIT 50 OFFSET 200")
q("arg_max_state", """SELECT state, count(*) AS patients FROM dim_patients WHERE is_current GROUP BY 1
    ORDER BY patients DESC, state LIMIT 1""")
q("top_n_days_by_admissions", """SELECT * FROM (SELECT admission_day, daily_count, rank() OVER (ORDER BY daily_count DESC) AS rank
    FROM daily) WHERE rank <= 5""")
q("top_n_days_per_type", """SELECT * FROM (SELECT admission_type, admission_date::DATE AS admission_day, count(*) AS visits,
    rank() OVER (PARTITION BY admission_type ORDER BY count(*) DESC) AS rank FROM fact_encounters GROUP BY 1, 2) WHERE rank <= 2""")
q("union_all_movements", """SELECT encounter_key, admission_date AS at, 'in' AS direction FROM fact_encounters
    UNION ALL SELECT encounter_key, discharge_date, 'out' FROM fact_encounters WHERE discharge_date IS NOT NULL""")

q("scalar_time", """SELECT encounter_key, date_trunc('hour', admission_date)::TIMESTAMP AS hour_slot,
    coalesce(hour(discharge_date), 12) AS discharge_hour,
    (year(admission_date) - 1995) * 12 + month(admission_date) - 1 AS months, month(admission_date) - 1 AS months_wrapped,
    admission_date + INTERVAL 6 DAY - INTERVAL 3 HOUR AS shifted, los_us / 3600e6 AS hours FROM fact_encounters""")
q("scalar_numbers", f"""SELECT event_id, CASE WHEN value > 60 THEN 60e0 WHEN value < 0 THEN 0e0 ELSE value END AS clipped,
    {rnd('value', 1)} AS rounded, value / nullif((user_id % 3)::DOUBLE, 0) AS ratio,
    (props->>'$.k')::BIGINT AS k FROM events""")
q("scalar_text", f"""SELECT patient_key, first_name || ' ' || last_name AS name,
    coalesce(city, '') || '/' || coalesce(CASE WHEN record_version > 1 THEN state END, '') AS place,
    city || ' ' || CASE WHEN record_version > 1 THEN state END AS place_or_null, {age('date_of_birth')} AS age,
    insurance_category AS category, state IS DISTINCT FROM CASE WHEN record_version > 1 THEN state END AS state_differs
    FROM stg_p""")
