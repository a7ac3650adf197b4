"""Models on the smallest data, with few trees."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import evaluation
from wardline.plans import feeds, learning as ml, risk
from wardline.session import new_folder
from wardline.sources.tables import materialize


@pytest.fixture(scope="module")
def training(star):
    return materialize(ml.training_set(star.encounters, star.patients, star.departments, star.as_of), "training")


@pytest.fixture(scope="module")
def asks(star):
    return feeds.score_requests(star.encounters, star.patients, star.departments, star.as_of)


@pytest.fixture(scope="module")
def parts(training):
    rows = ml.split(training, label="readmitted_30d")
    return rows.where("is_train").drop("is_train"), rows.where("NOT is_train").drop("is_train")


def test_split_is_exact_per_class(training):
    rows = ml.split(training, label="readmitted_30d").groupBy("readmitted_30d").agg(
        F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("train"))
    for r in rows.collect():
        assert r.train == int(r.n * 0.8)


def test_readmission_model(spark, parts, asks):
    train, test = parts
    model, again = ml.train_readmission(train, trees=8), ml.train_readmission(train, trees=8)
    auc = ml.evaluate_readmission(model, test)["roc_auc"]
    assert 0 <= auc <= 1 and auc == ml.evaluate_readmission(again, test)["roc_auc"]
    assert ml.importances(model, "readmission").agg(F.sum("importance")).first()[0] == pytest.approx(1, abs=0.001)
    report = ml.classification_report(model.transform(ml.prepare(test)))
    assert report.agg(F.sum("support")).first()[0] == test.count()
    path = new_folder(spark, "model")
    ml.save(model, path)
    features = risk.requests_to_features(asks, "readmission")
    scores = ml.score_readmission(ml.load(path), features)
    assert scores.count() == asks.count()
    bad = scores.where(
        "probability_readmitted NOT BETWEEN 0 AND 1 OR risk_band != CASE WHEN risk_score >= 70 THEN 'High Risk' "
        "WHEN risk_score >= 40 THEN 'Medium Risk' ELSE 'Low Risk' END")
    assert bad.count() == 0
    assert sorted(map(str, scores.collect())) == sorted(map(str, ml.score_readmission(model, features).collect()))


def test_figures_equal_sql_over_the_stored_scores(spark, parts):
    """Every figure of both forests from the scored rows, by DuckDB."""
    train, test = parts
    scored = ml.scored_readmissions(ml.train_readmission(train, trees=8), test)
    path = new_folder(spark, "scores")
    scored.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW s AS SELECT *, readmitted_30d AS y FROM read_parquet('{path}/*.parquet')")
    auc = con.execute("""SELECT (sum(place) FILTER (y = 1) - p * (p + 1) / 2) / (p * n) FROM (
        SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS place,
        count(*) FILTER (y = 1) OVER () AS p, count(*) FILTER (y = 0) OVER () AS n FROM s) GROUP BY p, n""").fetchone()[0]
    got = ml.binary_figures(scored, "readmitted_30d", "score", F.col("prediction"))
    assert got["roc_auc"] == pytest.approx(auc, abs=6e-5)
    rows, right = con.execute("SELECT count(*), count(*) FILTER (prediction = y) FROM s").fetchone()
    assert (got["test_rows"], got["accuracy"]) == (rows, round(right / rows, 4))
    want = con.execute("""SELECT c, count(*) FILTER (y = c AND prediction = c) / nullif(count(*) FILTER (prediction = c), 0)::DOUBLE,
        count(*) FILTER (y = c AND prediction = c) / count(*) FILTER (y = c)::DOUBLE, count(*) FILTER (y = c)
        FROM s, (VALUES (0), (1)) t(c) GROUP BY c ORDER BY c""").fetchall()
    report = ml.classification_report(scored).orderBy("label").collect()
    assert [(r.label, r.precision, r.recall, r.support) for r in report] == [pytest.approx(w) if None not in w else w for w in want]
    model = ml.train_los(train, trees=5)
    target = X.clip("length_of_stay", 0.0, ml.LOS_CAP)
    path = new_folder(spark, "stays")
    model.transform(ml.prepare(test).withColumn("target", target)).select("target", "prediction").write.parquet(path)
    mae, rmse, r2 = con.execute(f"""SELECT avg(abs(prediction - target)), sqrt(avg((prediction - target) ** 2)),
        1 - avg((prediction - target) ** 2) / var_pop(target) FROM read_parquet('{path}/*.parquet')""").fetchone()
    assert ml.evaluate_los(model, test) == pytest.approx({"mae": mae, "rmse": rmse, "r2": r2}, abs=6e-5)


def test_area_under_the_curve_by_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.1, 0.2, 0.25, 0.9, rng.random() * 1e-9]), int(rng.random() < 0.3)) for _ in range(400)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "score double, label int")
    good, bad = ([s for s, y in rows if s is not None and y == c] for c in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert evaluation.auc(df, "score", "label").first()[0] == pytest.approx(want)
    assert evaluation.auc(df.where("label = 1"), "score", "label").first()[0] is None
    assert evaluation.auc(df.withColumn("score", F.lit(0.3)), "score", "label").first()[0] == 0.5
    assert evaluation.auc(df.limit(0), "score", "label").first()[0] is None


def test_los_model_spread(parts, asks):
    model = ml.train_los(parts[0], trees=5)
    assert set(ml.evaluate_los(model, parts[1])) == {"mae", "rmse", "r2"}
    features = risk.requests_to_features(asks, "los").limit(20)
    rows = ml.prepare(features)
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    rows = rows.cache()
    spread = {r.encounter_key: (r.tree_mean, r.tree_std) for r in ml.tree_spread(model.stages[-1], rows).collect()}
    for r in rows.collect():
        single = [tree.predict(r.features) for tree in model.stages[-1].trees]
        assert spread[r.encounter_key] == pytest.approx((np.mean(single), np.std(single)))
    scores = ml.score_los(model, risk.requests_to_features(asks, "los"))
    assert scores.where("lower_bound < 0 OR lower_bound > predicted_los OR upper_bound < predicted_los").count() == 0


def test_the_trees_are_applied_once_to_equal_features(spark, parts, monkeypatch):
    """Rows that differ in key only share one application; keys may come twice or be missing."""
    rng = random.Random(8)
    kinds = [(age, rng.choice(["Cardiac", "General"]), hour) for age in (None, 0, 17, 44, 80) for hour in (None, 0, 5, 23)]
    rows = [(None if i == 3 else i // 2, *kind) for i, kind in enumerate(kinds * 12)]
    features = spark.createDataFrame(rows, "encounter_key int, age int, diagnosis_category string, hour int").selectExpr(
        "encounter_key", "age", "'General' AS department_name", "diagnosis_category", "0L AS num_previous_visits",
        "'Medicare' AS insurance_type", "timestamp_ntz'2024-01-07' + make_interval(0, 0, 0, 0, hour) AS admission_date")
    model = ml.train_los(parts[0], trees=5)
    each = model.transform(ml.prepare(features))
    plain = ml.tree_spread(model.stages[-1], each).select("encounter_key", "prediction", "tree_mean", "tree_std")
    want = sorted(map(str, plain.collect()))
    applied, spread_of = [], ml.tree_spread
    monkeypatch.setattr(ml, "tree_spread", lambda forest, df: applied.append((df.count(), df.rdd.getNumPartitions())) or spread_of(forest, df))
    monkeypatch.setattr(ml, "CELL_ROWS", 6, raising=False)
    assert ml.score_los(model, features).count() == len(rows)
    assert applied == [(each.select("features").distinct().count(), 4)]
    assert applied[0][0] <= len(kinds)
    got = ml.rows_with_spread(model, features).select("encounter_key", "prediction", "tree_mean", "tree_std")
    assert sorted(map(str, got.collect())) == want
    assert ml.score_los(model, features.limit(0)).count() == 0


def test_missing_age_takes_the_training_median(spark):
    rows = [(i, age, "Medical", "Private", "General", 0, 1.0) for i, age in enumerate([10, 20, 60])]
    schema = "encounter_key int, age int, department_name string, insurance_type string, diagnosis_category string, num_previous_visits int, length_of_stay double"
    known = ml.prepare(spark.createDataFrame(rows, schema))
    fitted = ml.feature_pipeline("readmission", known).fit(known)
    new = spark.createDataFrame([(9, None, "General", None, "Cardiac", -3, None)], schema)
    got = fitted.transform(ml.prepare(new)).first()
    assert (got.age_filled, got.department_encoded, got.insurance_encoded) == (20.0, 1.0, 1.0)
    assert (got.num_previous_visits, got.length_of_stay, got.diagnosis_severity, got.admission_hour) == (0, 0.0, 5, 12)


def test_risk_score_bounds(spark):
    rows = [
        (80, 11, 5, "Emergency", "Self-Pay/Uninsured", True), (76, 0, 4, "Transfer", "Medicaid", False),
        (50, 1, 0, "Scheduled", "Medicare", False), (66, 10, 3, "Emergency", "Private", False),
    ]
    df = spark.createDataFrame(rows, "age long, length_of_stay long, prior_visits long, admission_type string, insurance_type string, has_chronic boolean")
    got = [(r.risk_score, r.risk_level) for r in risk.risk_score(df).collect()]
    assert got == [(100, "HIGH RISK"), (70, "HIGH RISK"), (0, "LOW RISK"), (50, "MODERATE RISK")]
    factors = risk.risk_score(df).first().factors
    assert factors[0] == "Age 80 (senior population)" and len(factors) == 6


def test_the_median_is_exact(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "age")
    assert ml.median_age(rows) == 49_999.5
    assert ml.median_age(rows.limit(0)) == 0.0


def test_the_cut_of_a_class_is_sent_to_the_rows(spark):
    """By class all rows would meet in one task each; no row is dealt by the class alone."""
    rows = spark.range(1000).selectExpr("id AS encounter_key", "cast(id % 10 = 0 AS int) AS readmitted_30d")
    plan = ml.split(rows, label="readmitted_30d")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [readmitted_30d" not in plan and "BroadcastHashJoin [readmitted_30d" in plan


def test_blocks_hold_all_rows(spark):
    cells = spark.createDataFrame([(1, 1), (2, 4), (3, 11), (4, 8)], "cell int, n long")
    got = {}
    for r in ml.blocks(cells, 4).collect():
        got.setdefault(r.cell, []).append(r.weight)
    assert {c: sorted(w) for c, w in got.items()} == {1: [1.0], 2: [4.0], 3: [3.0, 4.0, 4.0], 4: [4.0, 4.0]}
    assert ml.blocks(cells, 1).count() == 24


def test_a_forest_does_not_depend_on_the_files_its_rows_lie_in(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(100), rng.choice(["Medical", "ICU"]), "Private", "General", rng.randrange(6), 1 + rng.random()) for i in range(900)]
    schema = "encounter_key int, age int, department_name string, insurance_type string, diagnosis_category string, num_previous_visits int, length_of_stay double"
    df = spark.createDataFrame(rows, schema)
    two, three = (ml.train_los(materialize(df.repartition(n), "seen"), trees=6).stages[-1] for n in (2, 3))
    assert [t.toDebugString.split("\n", 1)[1] for t in two.trees] == [t.toDebugString.split("\n", 1)[1] for t in three.trees]


def test_bin_edges_are_values_or_quantiles_of_all_rows(spark):
    few = spark.range(1000).selectExpr("id % 5 AS v")
    assert ml.bin_edges(few, "v", 10)[1:-1] == [0.5, 1.5, 2.5, 3.5]
    many = spark.range(3201).selectExpr("id / 100 AS v")
    assert ml.bin_edges(many, "v", 0.5)[1:-1] == pytest.approx(list(range(1, 32)))
    assert len(ml.bin_edges(few.limit(0), "v", 10)) == 3


@pytest.mark.parametrize("kind", ["readmission", "los"])
def test_a_forest_of_blocks_learns_what_a_forest_of_rows_does(spark, monkeypatch, kind):
    """Stays and returns that follow from the features; many rows are few blocks, and figures agree."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        age, visits, dept = rng.randrange(100), rng.randrange(6), rng.choice(["Medical", "Surgery", "ICU"])
        los = 3.0 + (age > 60) * 4 + (dept == "ICU") * 6 + rng.randrange(24) / 24
        rows.append((i, age, dept, "Private", "General", visits, los, int(visits > 3 and dept == "ICU" or rng.random() < 0.05)))
    schema = ("encounter_key int, age int, department_name string, insurance_type string, diagnosis_category string, "
              "num_previous_visits int, length_of_stay double, readmitted_30d int")
    df = materialize(spark.createDataFrame(rows, schema).repartition(3), "seen")
    train = ml.train_readmission if kind == "readmission" else ml.train_los
    figure = (lambda m: ml.evaluate_readmission(m, df)["accuracy"]) if kind == "readmission" else (lambda m: ml.evaluate_los(m, df)["mae"])
    plain = train(df, trees=10)
    monkeypatch.setattr(ml, "FOREST_ROWS", 500)
    dealt = []
    monkeypatch.setattr(ml, "_dealt", lambda rows, n: dealt.append((n, rows.agg(F.sum("weight")).first()[0])) or rows)
    blocked = train(df, trees=10)
    assert dealt[0][1] == 6000 and dealt[0][0] < 6000
    assert figure(blocked) == pytest.approx(figure(plain), rel=0.15)
    a, b = (m.stages[-1].featureImportances.toArray() for m in (plain, blocked))
    assert np.abs(a - b).max() < 0.2
    assert "in {" in blocked.stages[-1].toDebugString  # departments stay categories
    assert ml.score_readmission(blocked, df).count() == 6000 if kind == "readmission" else ml.score_los(blocked, df).count() == 6000
    path = new_folder(spark, "model")
    ml.save(blocked, path)
    assert ml.load(path).stages[-1].totalNumNodes == blocked.stages[-1].totalNumNodes
