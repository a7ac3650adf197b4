"""Figures of scored tables, each from one pass over rows that are scored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.sources.tables import materialize

SCORE_BINS = 4096


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row, ``roc_auc``: the share of (positive, negative) pairs that the score puts right, ties counting half.

    Rows are counted per score. Scores are dealt over SCORE_BINS equal ranges between the least and
    the largest, so the ordered steps see the scores of one range, and one row per range. NULL without a pair.
    """
    counts = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        X.count_where(F.col(label) == 1).alias("p"), X.count_where(F.col(label) != 1).alias("n")
    )
    counts = materialize(counts, "scores")
    low, high = counts.agg(F.min("s")).scalar(), counts.agg(F.max("s")).scalar()
    place = F.coalesce(F.floor((F.col("s") - low) / F.nullif(high - low, F.lit(0.0)) * SCORE_BINS), F.lit(0))
    binned = counts.withColumn("bin", place)
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("bin").agg(F.sum("n").alias("bin_n")).select("bin", F.coalesce(F.sum("bin_n").over(earlier), F.lit(0)).alias("below"))
    inside = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("below_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bins, "bin")
    # Twice the pairs that are right, as whole numbers: decimals, for they are products of counts.
    right = F.col("p").cast("decimal(19,0)") * (2 * (F.col("below") + F.col("below_inside")) + F.col("n")).cast("decimal(19,0)")
    pairs = 2.0 * F.sum("p") * F.sum("n")
    return placed.agg((F.sum(right).cast("double") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def confusion(scored: DataFrame, prediction: Column, label: str) -> DataFrame:
    """One row: the four counts of a prediction of 0 or 1 against its label."""
    real, said = F.col(label) == 1, prediction == 1
    return scored.agg(
        X.count_where(real & said).alias("tp"), X.count_where(~real & said).alias("fp"),
        X.count_where(real & ~said).alias("fn"), X.count_where(~real & ~said).alias("tn"),
    )


def report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes, one row each, from the four counts."""
    classes = F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.col("tn").alias("hits"), (F.col("tn") + F.col("fn")).alias("said"), (F.col("tn") + F.col("fp")).alias("support")),
        F.struct(F.lit(1).alias("label"), F.col("tp").alias("hits"), (F.col("tp") + F.col("fp")).alias("said"), (F.col("tp") + F.col("fn")).alias("support")),
    ))
    rows = counts.select(classes.alias("c")).select("c.*")
    return rows.select(
        "label", X.ratio("hits", "said").alias("precision"), X.ratio("hits", "support").alias("recall"),
        X.ratio(F.col("hits") * 2, F.col("said") + F.col("support")).alias("f1"), "support",
    )


def regression(scored: DataFrame, prediction: str, target: str) -> DataFrame:
    """One row: mean absolute error, root mean squared error and R2, rounded to four places; NULL without rows."""
    error = F.col(prediction) - F.col(target)
    spread = F.var_pop(target)
    return scored.agg(
        F.round(F.avg(F.abs(error)), 4).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(1 - F.avg(error * error) / F.nullif(spread, F.lit(0.0)), 4).alias("r2"),
    )
