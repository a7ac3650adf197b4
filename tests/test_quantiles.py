import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators.quantiles import aggregate_with_quantiles, distributed_quantiles, value_at_share

WANTED = {"q1": 0.25, "med": 0.5, "p95": 0.95}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randrange(-50, 5000), 77])) for _ in range(2000)]
    rows += [("one", 5), ("none", None)]
    return spark.createDataFrame(rows, "g string, v long").cache(), rows


def check(got, rows):
    for r in got:
        values = [v for g, v in rows if g == r.g and v is not None]
        for name, q in WANTED.items():
            want = float(np.quantile(values, q)) / 2 if values else None
            assert r[name] == pytest.approx(want) if values else r[name] is None


def test_aggregates_with_quantiles(data):
    df, rows = data
    got = aggregate_with_quantiles(df, ["g"], [F.count("*").alias("n")], F.col("v"), WANTED, 2.0, 100).collect()
    assert {r.g: r.n for r in got} == {g: sum(x == g for x, _ in rows) for g in {g for g, _ in rows}}
    check(got, rows)


def test_groups_without_a_value_stay(data):
    """Also without other aggregates, and however large the other groups are."""
    df, rows = data
    got = aggregate_with_quantiles(df, ["g"], [], F.col("v"), WANTED, 2.0, 100).collect()
    assert {r.g for r in got} == {g for g, _ in rows}
    check(got, rows)


def test_distributed_without_keys(data):
    df, rows = data
    got = distributed_quantiles(df, [], F.col("v"), WANTED, bin_width=50).first()
    values = [v for _, v in rows if v is not None]
    for name, q in WANTED.items():
        assert got[name] == pytest.approx(np.quantile(values, q))


def test_value_at_share(spark):
    rows = [(g, i * 7) for g in ("x", "y") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: r.cut for r in value_at_share(df, ["g"], F.col("v"), 0.8, "cut", 20).collect()}
    assert got == {"x": 39 * 7, "y": 39 * 7}
