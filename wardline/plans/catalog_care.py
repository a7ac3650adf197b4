"""Names of the history, loading, quality, occupancy, monitoring and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import changes, evaluation, history, occupancy, quality, relations
from wardline.plans import clinical, dashboards as dash, feeds, learning as ml, lookups, marts, risk, staging
from wardline.plans.refresh import ViewStore
from wardline.registry import AS_OF, PATIENT, register
from wardline.session import new_folder
from wardline.sources import schemas, tables
from wardline.sources.reference import reference_data
from wardline.sources.stored import StoredFact
from wardline.sources.versions import VersionStore
from wardline.streaming import jobs, monitor

EVENTS = "events*.parquet"
MARK = "2001-06-01 00:00:00"
HALF = "1998-06-15 12:00:00"

# --- joins and occupancy ------------------------------------------------------------------------

register("existing_patients_seen_in_emergency", lambda s: relations.existing_rows(
    s.patients.select("patient_key", "patient_id"),
    s.encounters.where(F.col("admission_type") == "Emergency"), "patient_key"))
register("orphans_patient_versions_without_visit",
         lambda s: relations.orphans(s.patients.select("patient_key", "patient_id"), s.encounters, "patient_key"))
register("readmitted_flag", lambda s: relations.readmitted_flag(
    s.encounters.select("patient_id", "encounter_key", "admission_date", "discharge_date")))
register("temporal_join", lambda s: relations.temporal_join(
    s.encounters.select("patient_id", "encounter_key", "admission_date"),
    s.patients.select("patient_id", "record_version", "valid_from", "valid_to", "insurance_type", "city"),
    "patient_id", "admission_date"))
register("readmission_chains", lambda s: clinical.readmission_chains(s.encounters))
register("readmission_chain_lengths", lambda s: clinical.readmission_chain_lengths(s.encounters))
register("bed_stays", lambda s: occupancy.bed_stays(s.bed_events))
register("bed_utilization", lambda s: occupancy.bed_utilization(s.bed_events, s.departments))
register("bed_timeline", lambda s: occupancy.bed_timeline(s.bed_events, s.departments))
register("bed_timeline_first_100", lambda s: occupancy.bed_timeline(s.bed_events, s.departments, 100))
register("first_event_per_bed", lambda s: occupancy.first_event_per_bed(s.bed_events))
register("hourly_slots", lambda s: s.bed_events.groupBy("department_key").agg(
    X.trunc_ntz("hour", F.min("event_timestamp")).alias("lo"), X.trunc_ntz("hour", F.max("event_timestamp")).alias("hi"),
).select("department_key", occupancy.hourly_slots(F.col("lo"), F.col("hi")).alias("time_slot")))

register("list_departments_with_staff", lambda s: lookups.list_departments(
    relations.existing_rows(s.departments, s.physicians, "department_key")))
register("reference_data_staffing", lambda s: reference_data(s.spark)
         .select("department_name", "bed_capacity", F.explode("specialties").alias("specialty"))
         .join(s.physicians.groupBy("specialty").agg(F.count("*").alias("physicians")), "specialty", "left"))

# --- history and loading ------------------------------------------------------------------------


def _feed(s) -> DataFrame:
    return feeds.incoming_patients(s.patients, s.physicians)


def _merge(s) -> DataFrame:
    return history.scd2_merge(s.patients, _feed(s), "patient_id", feeds.TRACKED)


register("insurance_changes", lambda s: history.insurance_changes(s.patients))
register("insurance_changes_since", lambda s: history.insurance_changes(s.patients, "2000-06-01"))
register("address_changes", lambda s: history.address_changes(s.patients))
register("version_counts", lambda s: history.version_counts(s.patients))
register("scd2_changes", lambda s: history.scd2_changes(s.patients, _feed(s), "patient_id", feeds.TRACKED).select(
    "patient_id", "record_version", "valid_from", "valid_to", "is_current", *feeds.TRACKED))
register("scd2_merge", _merge)
register("scd2_update", lambda s: history.scd2_update(
    s.patients, PATIENT, {"address": "9 Mill Lane", "city": "Tulsa", "state": "OK", "zip_code": "74103"},
    "2001-10-01 00:00:00"))
register("late_changes", lambda s: history.late_changes(
    s.patients, _feed(s).withColumn("effective_at", X.shift("effective_at", years=-3)), "patient_id"))
register("detect_changes", lambda s: changes.detect_changes(s.patients, _feed(s), "patient_id", feeds.TRACKED).select(
    "patient_id", "effective_at", "change_type"))


def _after_merge_is_noop(s) -> DataFrame:
    """Merging the same feed into the merged dimension finds no change."""
    merged = tables.materialize(_merge(s), "merged")
    again = history.scd2_changes(merged, _feed(s), "patient_id", feeds.TRACKED)
    return again.agg(F.count("*").alias("changes_on_second_run"))


register("scd2_merge_twice", _after_merge_is_noop)


def _split_counts(s) -> DataFrame:
    parts = changes.split_changes(changes.detect_changes(s.patients, _feed(s), "patient_id", feeds.TRACKED))
    return tables.row_counts(parts)


register("split_changes", _split_counts)
register("last_load_timestamp", lambda s: changes.last_load_timestamp(s.encounters))
register("incremental_rows", lambda s: changes.incremental_rows(s.encounters, X.ts(MARK)).select("encounter_key", "created_at"))
register("incremental_rows_lookback", lambda s: changes.incremental_rows(
    s.encounters, changes.last_load_timestamp(s.encounters.where(F.col("created_at") <= X.ts(MARK))).scalar(),
    lookback_hours=24, loaded=s.encounters.where(F.col("created_at") <= X.ts("2001-05-31 12:00:00")), key="encounter_key",
).select("encounter_key", "created_at"))
register("check_watermark", lambda s: changes.check_watermark(s.encounters, X.ts("2001-12-01")))
register("load_trend", lambda s: changes.load_trend(feeds.load_history(s.encounters)))
register("empty_loads", lambda s: changes.empty_loads(feeds.load_history(s.encounters), "2001-08-01"))
register("recent_loads", lambda s: changes.recent_loads(feeds.load_history(s.encounters)))


def _append_and_reload(s) -> DataFrame:
    folder = new_folder(s.spark, "load") + "/fact_bed_events"
    for kind in ("bed_assigned", "bed_discharged"):
        tables.append(s.bed_events.where(F.col("event_type") == kind), folder)
    return tables.load_table(s.spark, folder.rsplit("/", 1)[0], "fact_bed_events")


def _export_and_reload(s) -> DataFrame:
    path = new_folder(s.spark, "export")
    report = clinical.length_of_stay(s.encounters, s.departments)
    tables.export(report, path, "csv")
    return s.spark.read.schema(report.schema).option("header", "true").csv(path)


def _record_load(s) -> DataFrame:
    from datetime import datetime, timedelta

    path, start = new_folder(s.spark, "history"), datetime(2001, 9, 1)
    counts = {r["table_name"]: r["row_count"] for r in tables.row_counts(s.tables).collect()}
    for i, name in enumerate(sorted(counts), 1):
        changes.record_load(s.spark, path, name, counts[name], start, start + timedelta(seconds=1.5), i)
    return s.spark.read.parquet(path)


def _view_after_loads(s, name: str) -> DataFrame:
    """A view after the first half of the visits was loaded, then the rest: only what the rest touches is computed anew."""
    folder = new_folder(s.spark, "views")
    store = ViewStore(
        s.spark, folder, StoredFact(s.spark, f"{folder}/visits", schemas.FACT_ENCOUNTERS, "admission_date", "patient_id"),
        StoredFact(s.spark, f"{folder}/beds", schemas.FACT_BED_EVENTS, "event_timestamp", "encounter_key"),
        s.departments, s.physicians, s.patients, s.as_of, [name],
    )
    for part in (F.col("created_at") < X.ts(HALF), F.col("created_at") >= X.ts(HALF)):
        visits, beds = (tables.materialize(df.where(part), "load") for df in (s.encounters, s.bed_events))
        store.load(visits, beds)
    return store.read(name)


for _view in marts.VIEWS:
    register(f"{_view}_after_loads", lambda s, n=_view: _view_after_loads(s, n))


def _stored_period(s) -> DataFrame:
    """Visits of one quarter from a fact stored by month: other months are not opened."""
    fact = StoredFact(s.spark, new_folder(s.spark, "stored"), schemas.FACT_ENCOUNTERS, "admission_date", "patient_id")
    fact.load(s.encounters)
    return fact.period("1997-01-01 00:00:00", "1997-04-01 00:00:00").select("encounter_key", "patient_id", "admission_date")


register("stored_visits_of_a_quarter", _stored_period)


def _refresh(s) -> DataFrame:
    return marts.refresh_marts(s.spark, marts.view_builders(s.tables, s.as_of), new_folder(s.spark, "marts"))


register("append_bed_events", _append_and_reload)
register("export_length_of_stay", _export_and_reload)
register("record_load", _record_load)
register("refresh_marts", lambda s: _refresh(s).drop("seconds", "error"))

# --- quality ------------------------------------------------------------------------------------

for _rule in quality.RULES:
    register(f"dq_{_rule.build.__name__}", lambda s, r=_rule: r.build(s.tables, s.as_of))
register("dq_unique_patient_id", lambda s: quality.unique_violations(s.patients, "patient_id"))
register("dq_not_null_discharge", lambda s: quality.not_null_violations(s.encounters, "discharge_date", "encounter_key"))
register("dq_column_tests", lambda s: quality.column_tests(staging.build_graph(s.tables, s.as_of)))
register("dq_row_rules", lambda s: quality.row_violations(s.encounters, "encounter_key", {
    "date_range": quality.bad_date_range("admission_date", "discharge_date", "2001-06-01"),
    "positive_integer": quality.not_positive_integer("encounter_key"),
    "required": quality.missing_fields(s.encounters, ["patient_key", "discharge_date"])}))
register("dq_probability", lambda s: quality.row_violations(
    s.requests, "request_id", {"probability": quality.not_probability("duration_seconds")}))
register("dq_run_rules", lambda s: quality.run_rules(s.tables, s.as_of))
register("dq_summary", lambda s: quality.summarize(quality.run_rules(s.tables, s.as_of)))


def _user_rule(s) -> DataFrame:
    rules: list[quality.Rule] = []
    quality.register_rule(
        rules, "Stays are shorter than ten days",
        "SELECT encounter_key FROM {fact_encounters} WHERE timestampdiff(DAY, admission_date, discharge_date) >= 10", "warning")
    quality.register_rule(
        rules, "Physicians have a department", lambda t, as_of: t["dim_physicians"].where("department_key IS NULL").select("physician_key"))
    return quality.run_rules(s.tables, s.as_of, rules)


register("dq_user_rules", _user_rule)


def _planted(s) -> dict[str, DataFrame]:
    """The star with defects at keys of a fixed stride, so that every rule has something to find."""
    t = dict(s.tables)
    p, e, b = F.col("patient_key"), F.col("encounter_key"), F.col("bed_event_key")
    t["dim_patients"] = t["dim_patients"].withColumns({
        "first_name": F.when(p % 89 != 0, F.col("first_name")),
        "is_current": F.col("is_current") | (p % 3 == 0),
        "valid_to": F.when(p % 67 == 0, X.ts("2000-01-01 00:00:00")).otherwise(F.col("valid_to")),
    })
    t["fact_encounters"] = t["fact_encounters"].withColumns({
        "patient_key": F.when(e % 89 == 0, F.lit(-1)).otherwise(F.col("patient_key")),
        "department_key": F.when(e % 97 == 0, F.lit(-1)).otherwise(F.col("department_key")),
        "discharge_date": F.when(e % 83 == 0, F.col("admission_date")).otherwise(F.col("discharge_date")),
    })
    t["fact_bed_events"] = t["fact_bed_events"].withColumns({
        "encounter_key": F.when(b % 101 == 0, F.lit(-1)).otherwise(F.col("encounter_key")),
        "bed_number": F.when(b % 79 == 0, F.lit(0)).otherwise(F.col("bed_number")),
    })
    t["dim_physicians"] = t["dim_physicians"].where("department_key <> 1")
    return t


for _rule in quality.RULES:
    register(f"dq_planted_{_rule.build.__name__}", lambda s, r=_rule: r.build(_planted(s), s.as_of))
register("dq_planted_run_rules", lambda s: quality.run_rules(_planted(s), s.as_of))

# --- monitoring ---------------------------------------------------------------------------------

register("freshness", lambda s: monitor.freshness(s.encounters, s.as_of))
register("volume_anomalies", lambda s: monitor.volume_anomalies(s.encounters, "2001-08-01"))
register("validate_counts", lambda s: monitor.validate_counts(s.patients, s.encounters))
register("error_rate", lambda s: monitor.error_rate(s.requests))
register("error_rate_sliding", lambda s: monitor.error_rate(s.requests, "5 minutes", "1 minute"))
register("request_rate", lambda s: monitor.request_rate(s.requests))
register("latency_p95", lambda s: monitor.latency_p95(s.requests))
register("latency_p95_hourly", lambda s: monitor.latency_p95(s.requests, "1 hour"))
register("latency_buckets", lambda s: monitor.latency_buckets(s.requests, "1 hour"))
register("sustained_errors", lambda s: monitor.sustained(monitor.error_rate(s.requests, "30 minutes"), 3))
register("filter_logs_errors", lambda s: monitor.filter_logs(monitor.parse_logs(feeds.log_lines(s.requests)), "ERROR"))
register("filter_logs_path", lambda s: monitor.filter_logs(monitor.parse_logs(feeds.log_lines(s.requests)), path="/view"))
register("filter_logs_slow", lambda s: monitor.filter_logs(monitor.parse_logs(feeds.log_lines(s.requests)), slower_than=0.5))
register("count_by_labels", lambda s: monitor.count_by_labels(s.requests, ["method", "path", "status_code"]))
register("duration_histogram", lambda s: monitor.duration_histogram(s.requests, ["method", "path"]))
register("quality_checks_by_status",
         lambda s: monitor.count_by_labels(quality.run_rules(s.tables, s.as_of), ["severity", "passed"]))
register("quality_checks_by_check",
         lambda s: monitor.count_by_labels(quality.run_rules(_planted(s), s.as_of), ["test_name", "passed"]))
register("loads_by_status", lambda s: monitor.count_by_labels(
    feeds.load_history(s.encounters).withColumn("status", F.when(F.col("records_loaded") > 0, "loaded").otherwise("empty")),
    ["table_name", "status"]))


def _stream(job, **options):
    return lambda s: job(s.spark, f"{s.sf_dir}/{EVENTS}", new_folder(s.spark, "stream"), **options)


register("stream_error_rate", _stream(jobs.stream_error_rate))
register("stream_error_rate_sliding", _stream(jobs.stream_error_rate, slide="1 minute"))
register("stream_request_rate", _stream(jobs.stream_request_rate))
register("stream_latency", _stream(jobs.stream_latency))
register("stream_sustained", _stream(jobs.stream_sustained, k=2))


def _stream_scd2(s) -> DataFrame:
    return _streamed(s, _feed(s)).read()


def _early_feed(s) -> DataFrame:
    """The feed three years early: late for patients whose third version has begun by now."""
    return _feed(s).withColumn("effective_at", X.shift("effective_at", years=-3))


def _stream_scd2_set_aside(s) -> DataFrame:
    """What the stream's merge does not apply if late changes are not spliced, with the reason."""
    feed = _early_feed(s)
    return _streamed(s, feed, splice=False).set_aside(feed.schema).select("patient_id", "effective_at", "reason")


def _streamed(s, feed: DataFrame, **options) -> VersionStore:
    folder = new_folder(s.spark, "scd2")
    VersionStore(s.spark, folder, "patient_id", feeds.TRACKED, schemas.DIM_PATIENTS, buckets=16).create(s.patients)
    feed.write.parquet(f"{folder}/feed")
    source = s.spark.readStream.schema(feed.schema).parquet(f"{folder}/feed")
    jobs.stream_scd2(source, folder, "patient_id", feeds.TRACKED, **options)
    # A second run without new input has to find the same table.
    return jobs.stream_scd2(source, folder, "patient_id", feeds.TRACKED, **options)


def _stored_merge(s) -> DataFrame:
    """The feed in two deliveries into a stored dimension; the second finds the first's versions current."""
    store = VersionStore(s.spark, new_folder(s.spark, "store"), "patient_id", feeds.TRACKED, schemas.DIM_PATIENTS, buckets=16)
    store.create(s.patients)
    for batch, at in enumerate((feeds.FIRST_BATCH, feeds.SECOND_BATCH)):
        store.merge(_feed(s).where(F.col("effective_at") == X.ts(at)), batch)
    return store.read().drop("patient_key")


def _replayed(s, times: int = 2) -> tuple[DataFrame, jobs.Dropped]:
    """Every event in several files, as if a delivery came again."""
    folder = new_folder(s.spark, "replayed")
    for _ in range(times):
        s.source("events").coalesce(1).write.mode("append").parquet(folder)
    return jobs.stream_once(s.spark, folder, new_folder(s.spark, "stream"), files_per_batch=1)


register("stream_scd2", _stream_scd2)
register("stream_scd2_set_aside", _stream_scd2_set_aside)
register("scd2_apply_late", lambda s: history.scd2_apply(s.patients, _early_feed(s), "patient_id", feeds.TRACKED))
register("stream_scd2_late", lambda s: _streamed(s, _early_feed(s)).read())
register("scd2_stored_merge", _stored_merge)
register("stream_sustained_runs", lambda s: jobs.stream_sustained_runs(
    s.spark, f"{s.sf_dir}/{EVENTS}", new_folder(s.spark, "stream"), k=2, delay="1 hour")[0])
register("stream_events_once", lambda s: _replayed(s)[0].select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value"))
register("stream_events_dropped", lambda s: s.spark.createDataFrame([_replayed(s, 3)[1]], "late long, replayed long"))

# --- models -------------------------------------------------------------------------------------


def _training(s) -> DataFrame:
    return ml.training_set(s.encounters, s.patients, s.departments, s.as_of)


def _requests(s) -> DataFrame:
    return feeds.score_requests(s.encounters, s.patients, s.departments, AS_OF)


def _parts(s, label: str | None) -> tuple[DataFrame, DataFrame]:
    rows = tables.materialize(ml.split(tables.materialize(_training(s), "training"), label=label), "split")
    return rows.where("is_train").drop("is_train"), rows.where("NOT is_train").drop("is_train")


def _features(s) -> DataFrame:
    return _encoded(ml.prepare(_training(s)))


def _encoded(rows: DataFrame) -> DataFrame:
    out = ml.feature_pipeline("readmission", rows).fit(rows).transform(rows)
    return out.select(
        "encounter_key", F.col("age_filled").alias("age"), "length_of_stay", "num_previous_visits", "department_encoded",
        "diagnosis_severity", "insurance_encoded", "admission_hour")


def _features_with_gaps(s) -> DataFrame:
    """Every 89th age is taken away and filled with the median of the others."""
    rows = ml.prepare(_training(s))
    return _encoded(rows.withColumn("age", F.when(F.col("encounter_key") % 89 != 0, F.col("age"))))


def _metrics(s, values: dict[str, float], **frames: DataFrame) -> DataFrame:
    return s.spark.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


def _readmission_metrics(s) -> DataFrame:
    train, test = _parts(s, "readmitted_30d")
    return _metrics(s, ml.evaluate_readmission(ml.train_readmission(train), test))


def _los_metrics(s) -> DataFrame:
    train, test = _parts(s, None)
    return _metrics(s, ml.evaluate_los(ml.train_los(train), test))


def _readmission_report(s) -> DataFrame:
    train, test = _parts(s, "readmitted_30d")
    return ml.classification_report(ml.train_readmission(train).transform(ml.prepare(test)))


def _readmission_scores(s) -> DataFrame:
    """Trained, saved, loaded, and applied to the request table."""
    path = new_folder(s.spark, "model")
    ml.save(ml.train_readmission(_parts(s, "readmitted_30d")[0]), path)
    return ml.score_readmission(ml.load(path), risk.requests_to_features(_requests(s), "readmission"))


def _los_scores(s) -> DataFrame:
    path = new_folder(s.spark, "model")
    ml.save(ml.train_los(_parts(s, None)[0]), path)
    return ml.score_los(ml.load(path), risk.requests_to_features(_requests(s), "los"))


register("training_set", _training)
register("training_summary", lambda s: ml.readmission_rate(_training(s)))
register("feature_preparation", _features)
register("feature_preparation_with_gaps", _features_with_gaps)
register("severity_by_category", lambda s: ml.training_set(
    s.encounters, s.patients, s.departments, s.as_of,
    {"Chest pain": "Cardiac", "Shortness of breath": "Respiratory", "Fever": "Infectious Disease", "Back pain": "Orthopedic",
     "Injury/Trauma": "Trauma"},
).select("encounter_key", "diagnosis_category", X.severity("diagnosis_category").alias("severity")))


def _split(s, label: str | None = None) -> DataFrame:
    rows = tables.materialize(_training(s).select("encounter_key", "readmitted_30d"), "training")
    return ml.split(rows, label=label)


register("split_plain", _split)
register("split_stratified", lambda s: _split(s, "readmitted_30d"))
register("readmission_model_metrics", _readmission_metrics)
register("readmission_model_report", _readmission_report)
register("readmission_model_importances",
         lambda s: ml.importances(ml.train_readmission(_parts(s, "readmitted_30d")[0]), "readmission"))
register("readmission_model_scores", _readmission_scores)
register("los_model_metrics", _los_metrics)
register("los_model_importances", lambda s: ml.importances(ml.train_los(_parts(s, None)[0]), "los"))
register("los_model_scores", _los_scores)


def _model_split(s) -> DataFrame:
    """Training and test rows per class, as the models see them."""
    train, test = _parts(s, "readmitted_30d")
    counts = [x.groupBy("readmitted_30d").agg(F.count("*").alias("rows")).withColumn("part", F.lit(n)) for n, x in (("train", train), ("test", test))]
    return counts[0].unionByName(counts[1])


def _saved_readmission_model(s) -> DataFrame:
    """Scored requests, how many scores change when the model is saved and loaded, and wrong bands."""
    path, asks = new_folder(s.spark, "model"), risk.requests_to_features(_requests(s), "readmission")
    model = ml.train_readmission(_parts(s, "readmitted_30d")[0])
    ml.save(model, path)
    one = ml.score_readmission(model, asks)
    two = ml.score_readmission(ml.load(path), asks).select("encounter_key", F.col("probability_readmitted").alias("again"))
    band = F.when(F.col("risk_score") >= 70, "High Risk").when(F.col("risk_score") >= 40, "Medium Risk").otherwise("Low Risk")
    return one.join(two, "encounter_key").agg(
        F.count("*").alias("scored"),
        X.count_where(~F.col("probability_readmitted").eqNullSafe(F.col("again"))).alias("changed"),
        X.count_where(F.col("risk_band") != band).alias("wrong_bands"),
        X.count_where((F.col("risk_score") < 0) | (F.col("risk_score") > 100)).alias("out_of_range"),
    )


def _los_model_spread(s) -> DataFrame:
    """Whether the mean over the trees is the forest's prediction, and the bounds are in order."""
    model = ml.train_los(_parts(s, None)[0])
    asks = tables.materialize(risk.requests_to_features(_requests(s), "los"), "asks")
    spread = ml.rows_with_spread(model, asks)
    bounds = ml.score_los(model, asks)
    apart = spread.agg(X.count_where(F.abs(F.col("tree_mean") - F.col("prediction")) > 1e-9).alias("mean_is_not_prediction"))
    order = (F.col("lower_bound") > F.col("predicted_los")) | (F.col("upper_bound") < F.col("predicted_los"))
    return bounds.agg(F.count("*").alias("scored"), X.count_where(order).alias("out_of_order")).withColumn(
        "mean_is_not_prediction", apart.scalar())


def _risk_scored(s) -> DataFrame:
    """Risk scores of closed visits beside whether the patient came back, and whether the score says so."""
    flags = relations.readmitted_flag(s.encounters.select("patient_id", "encounter_key", "admission_date", "discharge_date"))
    scores = risk.risk_score(_requests(s)).select("encounter_key", "risk_score", (F.col("risk_score") >= 40).cast("int").alias("said"))
    return tables.materialize(scores.join(flags.select("encounter_key", "readmitted_30d"), "encounter_key"), "risk-scored")


def _forecast_figures(s) -> DataFrame:
    asks = _requests(s).select(
        "encounter_key", "department_name", "admission_type", X.buckets("age", *X.AGE_GROUPS).alias("age_group"), "los_days")
    found = risk.los_forecast(asks, dash.los_baseline(s.departments, s.encounters))
    return evaluation.regression(
        found.where("predicted_los IS NOT NULL").withColumn("target", X.clip("los_days", 0.0, ml.LOS_CAP)), "predicted_los", "target")


register("risk_score_auc", lambda s: evaluation.auc(_risk_scored(s), "risk_score", "readmitted_30d").select(
    F.round("roc_auc", 9).alias("roc_auc")))
register("risk_score_confusion", lambda s: evaluation.confusion(_risk_scored(s), F.col("said"), "readmitted_30d"))
register("risk_score_report", lambda s: evaluation.report(
    evaluation.confusion(_risk_scored(s), F.col("said"), "readmitted_30d")))
register("los_forecast_figures", _forecast_figures)
register("readmission_model_split", _model_split)
register("readmission_model_saved", _saved_readmission_model)
register("los_model_spread", _los_model_spread)
register("risk_score", lambda s: risk.risk_score(_requests(s)).select(
    "encounter_key", "risk_score", "risk_level", "recommendation", F.array_join("factors", "; ").alias("factors")))
register("los_forecast", lambda s: risk.los_forecast(
    _requests(s).select("encounter_key", "department_name", "admission_type", X.buckets("age", *X.AGE_GROUPS).alias("age_group")),
    dash.los_baseline(s.departments, s.encounters)))
register("requests_to_readmission_features", lambda s: risk.requests_to_features(_requests(s), "readmission"))
register("requests_to_los_features", lambda s: risk.requests_to_features(_requests(s), "los"))
