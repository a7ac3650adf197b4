"""Exact top-k against brute force with Python's integers."""

import math
import random

import pytest
from wardline.llm import topk

SF = "/root/testdata/sf0.001"


def brute(rows, k=10):
    own = []
    for vec_id, x in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            own.append((vec_id, [math.floor(1024 * v) if abs(v) < 1e300 else int(v) * 1024 for v in x]))
    out = []
    for at, (query, q) in enumerate(own):
        if query is None or query % 100:
            continue
        found = [(-sum(a * b for a, b in zip(q, c)), v is None, v or 0) for j, (v, c) in enumerate(own) if j != at and len(c) == len(q)]
        for rank, (score, none, v) in enumerate(sorted(found)[:k], 1):
            out.append((query, rank, None if none else v, max(min(-score, 2**63 - 1), -(2**63))))
    return sorted(out, key=str)


def result(df, **options):
    return sorted(map(tuple, topk.top_k(df, topk.F.col("id") % 100 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("sizes", [None, (2, 37), (5, 7)])
def test_embeddings(spark, sizes):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert result(df, sizes=sizes) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_ties_and_copies(spark):
    rng = random.Random(1)
    some = [[rng.choice([-0.5, 0.25, 1.0]) for _ in range(3)] for _ in range(4)]
    rows = [(i, some[i % 4]) for i in range(400)] + [(100, some[0]), (100, some[1]), (None, some[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(df, sizes=(3, 50)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.5, -2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [0.0, 0.0]), (100, [0.0, -0.0]),
        (200, [1.0]), (300, []), (400, []), (6, [1e18, 1e18]), (500, [1e17, -3e18]), (None, [0.5, 0.5]), (-100, [0.5, 0.5]), (7, [0.5, 0.5]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    assert result(df) == brute(rows)
    assert topk.exact_search(df.limit(0)).collect() == []
    alone = topk.exact_search(df.where("vec_id = 200"))
    assert alone.collect() == [] and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_large_numbers_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 14) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df, sizes=(1, 40)) == brute(rows)
    huge = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (100, [0.0, 1.0])]
    got = result(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    assert got == brute(huge)


def test_blocks_are_bounded():
    assert topk.block_sizes(1, 10, 800) == (1024, 1024)
    assert topk.block_sizes(10**7, 10**9, 800) == (65_536, 65_536)
    query, shard = topk.block_sizes(50_000, 5_000_000, 800)
    assert 200 <= -(-50_000 // query) * -(-5_000_000 // shard) <= 1700
