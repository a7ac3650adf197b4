"""Training sets, feature preparation, random forests, evaluation and scoring with pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import evaluation
from wardline.operators.ordered import HotKeys, hot_keys, ordered_rows
from wardline.operators.quantiles import aggregate_with_quantiles, distributed_quantiles, value_at_share
from wardline.operators.relations import readmitted_flag
from wardline.sources.tables import materialize

# Features in model order, forest settings, limits.
READMISSION_FEATURES = [
    "age", "length_of_stay", "num_previous_visits", "department_encoded", "diagnosis_severity", "insurance_encoded",
]
LOS_FEATURES = [
    "age", "num_previous_visits", "department_encoded", "diagnosis_severity", "insurance_encoded", "admission_hour",
]
TREES, MIN_LEAF, SEED = 100, 10, 42
READMISSION_DEPTH, LOS_DEPTH = 8, 10
LOS_CAP = 60.0
TRAIN_SHARE = 0.8
UNKNOWN = "Unknown"
# A forest draws single rows up to FOREST_ROWS of them, blocks of rows above that (see ``blocks``), and
# trains on TASK_ROWS in a task. A feature has at most BINS different values for it.
FOREST_ROWS, TASK_ROWS, BINS = 2_000_000, 50_000, 32
# A task applies the trees to CELL_ROWS different rows of features.
CELL_ROWS = 20_000
# Features that may have more than BINS values, with the width of the ranges their quantiles are found by.
BINNED = {"age_filled": 10, "length_of_stay": 1 / 24, "num_previous_visits": 100}


def training_set(
    encounters: DataFrame, patients: DataFrame, departments: DataFrame, as_of: str,
    categories: Mapping[str, str] | None = None, hot: HotKeys | None = None,
) -> DataFrame:
    """Closed encounters with demographics, earlier visits and the 30-day readmission target.

    ``categories`` maps complaints to diagnosis categories; without it all are 'General'.
    """
    visits = encounters.select(
        "encounter_key", "encounter_id", "patient_id", "department_key", "admission_date", "discharge_date", "chief_complaint"
    )
    hot = hot_keys(visits, ["patient_id"]) if hot is None else hot
    flagged = readmitted_flag(visits, hot=hot)
    order = ["admission_date", "encounter_key"]
    counted = ordered_rows(flagged, ["patient_id"], order, before={"num_previous_visits": F.lit(1)}, hot=hot)
    category = X.map_case("chief_complaint", categories, "General") if categories else F.lit("General")
    people = patients.where("is_current").select("patient_id", X.age_years("date_of_birth", as_of).alias("age"), "insurance_type")
    return (
        counted.withColumn("length_of_stay", X.los_days())
        .where(F.col("length_of_stay") > 0)
        .join(departments.select("department_key", "department_name"), "department_key")
        .join(people, "patient_id")
        .select(
            "encounter_key", "encounter_id", "patient_id", "admission_date", "discharge_date", "length_of_stay",
            category.alias("diagnosis_category"), "department_name", "age", "insurance_type", "num_previous_visits",
            "readmitted_30d",
        )
    )


def prepare(df: DataFrame) -> DataFrame:
    """Row-wise preparation: severity, filled labels, bounded counts, admission hour."""
    out = (
        df.withColumn("diagnosis_severity", X.severity("diagnosis_category"))
        .withColumn("department_name", F.coalesce("department_name", F.lit(UNKNOWN)))
        .withColumn("insurance_type", F.coalesce("insurance_type", F.lit(UNKNOWN)))
        .withColumn("num_previous_visits", F.greatest(F.coalesce("num_previous_visits", F.lit(0)), F.lit(0)))
        .withColumn("age", F.col("age").cast("double"))
    )
    if "length_of_stay" in df.columns:
        out = out.withColumn("length_of_stay", F.greatest(F.coalesce("length_of_stay", F.lit(0.0)), F.lit(0.0)))
    hour = X.hour_or("admission_date") if "admission_date" in df.columns else F.lit(12).cast("bigint")
    return out.withColumn("admission_hour", hour)


def median_age(rows: DataFrame) -> float:
    """The exact median of the known ages, 0 if there are none."""
    found = aggregate_with_quantiles(rows, [], [], F.col("age"), {"median": 0.5}, bin_width=10).first()
    return float(found["median"]) if found and found["median"] is not None else 0.0


def feature_pipeline(kind: str, rows: DataFrame, binned: bool = False) -> Pipeline:
    """Label encoding in alphabetical order, median age of ``rows`` for a missing one, feature vector.

    A label that training has not seen gets an index of its own; the median is the training one.
    With ``binned`` the vector holds bins of the features that may have many values.
    """
    encode = [
        StringIndexer(inputCol=src, outputCol=dst, stringOrderType="alphabetAsc", handleInvalid="keep")
        for src, dst in (("department_name", "department_encoded"), ("insurance_type", "insurance_encoded"))
    ]
    fill = f"SELECT *, coalesce(CAST(age AS DOUBLE), CAST('{median_age(rows)!r}' AS DOUBLE)) AS age_filled FROM __THIS__"
    impute = SQLTransformer(statement=fill)
    inputs = _inputs(kind)
    cut = []
    if binned:
        filled, many = impute.transform(rows), [c for c in inputs if c in BINNED]
        inputs = [f"{c}_bin" if c in many else c for c in inputs]
        edges = [bin_edges(filled, c, BINNED[c]) for c in many]
        # A bin is marked as a category; the sum is a plain number, as its feature was.
        plain = ", ".join(f"{c}_cut + 0D AS {c}_bin" for c in many)
        cut = [
            Bucketizer(splitsArray=edges, inputCols=many, outputCols=[f"{c}_cut" for c in many]),
            SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"),
        ]
    return Pipeline(stages=[*encode, impute, *cut, VectorAssembler(inputCols=inputs, outputCol="features")])


def _inputs(kind: str) -> list[str]:
    return ["age_filled" if f == "age" else f for f in (READMISSION_FEATURES if kind == "readmission" else LOS_FEATURES)]


def bin_edges(rows: DataFrame, column: str, width: float) -> list[float]:
    """Edges of at most BINS bins: one for each value, or else between the quantiles of all rows."""
    value = F.col(column).cast("double")
    known = rows.agg(F.approx_count_distinct(value)).first()[0]
    values = [r[0] for r in rows.select(value).distinct().limit(BINS + 1).collect()] if known <= 2 * BINS else []
    if 0 < len(values) <= BINS:
        values.sort()
        inner = [(a + b) / 2 for a, b in zip(values, values[1:])]
    else:
        found = distributed_quantiles(rows, [], value, {f"q{i}": i / BINS for i in range(1, BINS)}, width).first()
        inner = sorted({q for q in found or () if q is not None})
    return [-math.inf, *(inner or [0.0]), math.inf]


# --- split --------------------------------------------------------------------------------------


def key_hash(key: str) -> Column:
    """60 pseudo-random bits of a key, the same in every run."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def split(df: DataFrame, key: str = "encounter_key", label: str | None = None, share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``is_train`` for the ``share`` of rows with the smallest key hash, per class with a label.

    The cut is an order statistic of the hashes, found without sorting a class in one task. It is one
    row per class, and sent to the rows: by class, all rows would meet in as many tasks as there are classes.
    """
    keys = [label] if label else []
    rows = df.withColumn("_hash", key_hash(key))
    cut = value_at_share(rows, keys, F.col("_hash"), share, "_cut", bin_width=1 << 42)
    if label:
        rows = rows.join(F.broadcast(cut), label)
    else:
        rows = rows.withColumn("_cut", cut.scalar())
    return rows.withColumn("is_train", F.col("_hash") <= F.col("_cut")).drop("_hash", "_cut")


# --- training and evaluation --------------------------------------------------------------------


def train_readmission(train: DataFrame, trees: int = TREES) -> PipelineModel:
    forest = RandomForestClassifier(
        labelCol="readmitted_30d", featuresCol="features", numTrees=trees, maxDepth=READMISSION_DEPTH,
        minInstancesPerNode=MIN_LEAF, seed=SEED,
    )
    return _fit("readmission", prepare(train), forest)


def train_los(train: DataFrame, trees: int = TREES) -> PipelineModel:
    forest = RandomForestRegressor(
        labelCol="target", featuresCol="features", numTrees=trees, maxDepth=LOS_DEPTH, minInstancesPerNode=MIN_LEAF, seed=SEED
    )
    return _fit("los", prepare(train).withColumn("target", X.clip("length_of_stay", 0.0, LOS_CAP)), forest)


def _fit(kind: str, rows: DataFrame, forest: RandomForestClassifier | RandomForestRegressor) -> PipelineModel:
    """Encoders and forest over all rows; what a forest's passes read and keep is bounded, however many rows there are."""
    label = forest.getLabelCol()
    rows = materialize(rows.select("department_name", "insurance_type", "age", *_plain(kind), label), "forest-rows")
    n = rows.count()
    size = math.ceil(n / FOREST_ROWS)
    encoders = feature_pipeline(kind, rows, binned=size > 1).fit(rows)
    if size > 1:
        inputs = encoders.stages[-1].getInputCols()
        cells = encoders.transform(rows).groupBy(*inputs, *([label] if kind == "readmission" else []))
        whole = blocks(cells.agg(F.count("*").alias("n"), *([] if kind == "readmission" else [F.avg(label).alias(label)])), size)
        rows = materialize(whole, "forest-blocks")
        n, weight = rows.agg(F.count("*"), F.sum("weight")).first()
        # A leaf holds MIN_LEAF rows, and weights are whole numbers.
        forest.setWeightCol("weight").setMinInstancesPerNode(1).setMinWeightFractionPerNode((MIN_LEAF - 0.5) / weight)
        ready = encoders.stages[-1].transform(_dealt(rows, n))
    else:
        ready = encoders.transform(_dealt(rows, n))
    return PipelineModel([*encoders.stages, forest.fit(ready)])


def _plain(kind: str) -> list[str]:
    """The features that stand in a prepared row as they go into the vector."""
    return [f for f in _inputs(kind) if f != "age_filled" and not f.endswith("_encoded")]


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` stored rows dealt evenly over tasks of TASK_ROWS, in an order that is the same in every run."""
    if n > TASK_ROWS:
        return rows.repartition(math.ceil(n / TASK_ROWS)).sortWithinPartitions(*rows.columns)
    # A forest draws by task and place, and files of one length are read in any order.
    return rows.coalesce(1).sortWithinPartitions(*rows.columns) if len(rows.inputFiles()) > 1 else rows


def blocks(cells: DataFrame, size: int) -> DataFrame:
    """Cells of ``n`` equal rows as blocks of about ``size`` rows, each one row with its ``weight``.

    A forest sees no more of a row than its bins and its label (the regression: the sum of labels), so
    equal rows may be one weighted row. They are kept in blocks because trees draw them with replacement:
    whole cells would be drawn or left out at once.
    """
    count = F.ceil(F.col("n") / size)
    rest = [c for c in cells.columns if c != "n"]
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    own = cells.select(*rest, "n", count.alias("_k"), block.alias("_i"))
    weight = F.expr("n div _k + CASE WHEN _i < n % _k THEN 1 ELSE 0 END")
    return own.select(*rest, weight.cast("double").alias("weight"))


def importances(model: PipelineModel, kind: str) -> DataFrame:
    names = READMISSION_FEATURES if kind == "readmission" else LOS_FEATURES
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, round(float(v), 4)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def classification_report(scored: DataFrame, label: str = "readmitted_30d") -> DataFrame:
    """Precision, recall, F1 and support of both classes from the four confusion counts."""
    return evaluation.report(evaluation.confusion(scored, F.col("prediction"), label))


def binary_figures(scored: DataFrame, label: str, score: str, prediction: Column) -> dict[str, float]:
    """ROC AUC, accuracy, macro and weighted averages of precision, recall and F1, and the rows."""
    auc = evaluation.auc(scored, score, label).first()[0]
    counts = evaluation.confusion(scored, prediction, label)
    found = counts.first()
    report = evaluation.report(counts).collect()  # one row per class
    rows = sum(found)
    out = {"roc_auc": round(auc or 0.0, 4), "accuracy": round((found.tp + found.tn) / rows, 4) if rows else 0.0, "test_rows": float(rows)}
    for name in ("precision", "recall", "f1"):
        values = [(r[name] or 0.0, r["support"]) for r in report]
        out[f"macro_{name}"] = round(sum(v for v, _ in values) / len(values), 4)
        out[f"weighted_{name}"] = round(sum(v * n for v, n in values) / rows, 4) if rows else 0.0
    return out


def scored_readmissions(model: PipelineModel, test: DataFrame) -> DataFrame:
    """The test rows scored once and stored: label, probability, prediction."""
    scored = model.transform(prepare(test))
    return materialize(scored.select("encounter_key", "readmitted_30d", vector_to_array("probability")[1].alias("score"), "prediction"), "scored")


def evaluate_readmission(model: PipelineModel, test: DataFrame) -> dict[str, float]:
    return binary_figures(scored_readmissions(model, test), "readmitted_30d", "score", F.col("prediction"))


def evaluate_los(model: PipelineModel, test: DataFrame) -> dict[str, float]:
    scored = model.transform(prepare(test).withColumn("target", X.clip("length_of_stay", 0.0, LOS_CAP)))
    return evaluation.regression(scored, "prediction", "target").first().asDict()


def readmission_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("encounters"),
        (F.sum("readmitted_30d") / F.nullif(F.count("*"), F.lit(0))).alias("readmission_rate"),
        F.round(F.avg("length_of_stay"), 6).alias("avg_los"),
    )


# --- scoring ------------------------------------------------------------------------------------


def score_readmission(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = vector_to_array("probability")[1]
    score = F.col("risk_score")
    band = F.when(score >= 70, "High Risk").when(score >= 40, "Medium Risk").otherwise("Low Risk")
    return (
        model.transform(prepare(df))
        .withColumn("_p", p)
        .withColumn("risk_score", F.round(F.col("_p") * 100, 1))
        .select(
            *df.columns[:1], "risk_score", band.alias("risk_band"), F.round("_p", 4).alias("probability_readmitted"),
            (F.col("_p") >= threshold).cast("int").alias("predicted"),
        )
    )


def tree_spread(forest, df: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the single trees' predictions.

    Each tree is applied to the same feature vector in one pass inside the JVM.
    """
    rows = df
    names = [f"_tree_{i}" for i in range(forest.getNumTrees)]
    for name, tree in zip(names, forest.trees):
        tree.setPredictionCol(name)
        tree.setFeaturesCol("features")
        rows = tree.transform(rows)
    values = F.array(*names)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / len(names)
    squares = F.aggregate(F.array(*[(F.col(n) - F.col("tree_mean")) ** 2 for n in names]), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn("tree_mean", mean).withColumn("tree_std", F.sqrt(squares / len(names))).drop(*names)


def rows_with_spread(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The prepared rows with the forest's ``prediction``, ``tree_mean`` and ``tree_std``.

    A forest sees no more of a row than its features, so the trees are applied once to each combination of
    them, and all rows get its values. Features are whole years, hours, codes and counts, or bins where the
    forest has learnt from many rows. If all rows differ, the trees are applied to all of them.
    """
    *encoders, assembler, forest = model.stages
    rows = prepare(df)
    for stage in encoders:
        rows = stage.transform(rows)
    inputs = assembler.getInputCols()
    cells = materialize(rows.select(*inputs).distinct(), "cells")
    # Dealt by their number: small in bytes, they would be put together into one task.
    dealt = cells.repartition(max(1, math.ceil(cells.count() / CELL_ROWS)))
    spread = tree_spread(forest, forest.transform(assembler.transform(dealt)))
    # Staged, so that a join sees how small it is and leaves the rows where they are.
    return rows.join(materialize(spread.select(*inputs, "prediction", "tree_mean", "tree_std"), "cell-spread"), inputs)


def score_los(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted stay, not below 0, with mean +-1.96 standard deviations over the trees."""
    rows = rows_with_spread(model, df)
    predicted = F.greatest("tree_mean", F.lit(0.0))
    margin = F.col("tree_std") * 1.96
    return rows.select(
        *df.columns[:1],
        F.round(predicted, 1).alias("predicted_los"),
        F.round(F.greatest(predicted - margin, F.lit(0.0)), 1).alias("lower_bound"),
        F.round(predicted + margin, 1).alias("upper_bound"),
    )


def save(model: PipelineModel, path: str) -> None:
    """Encoders, imputation and forest in one folder."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
