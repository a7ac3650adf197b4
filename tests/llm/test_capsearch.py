"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest
from wardline.llm import capsearch

SF = "/root/testdata/sf0.01"


def all_pairs(rows, least=0.95):
    """{row number: (links, smallest id reachable)} by comparing everything with everything."""
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in own], float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[own[a]].add(own[b])
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None))
    return out


def result(df):
    return sorted((tuple(r) for r in capsearch.embedding_components(df).collect()), key=str)


def want(rows):
    return sorted(((r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, all_pairs(rows).values())), key=str)


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(df) == want(rows)


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = capsearch.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.98 * 3000


@pytest.mark.parametrize("dim", [1, 2])
def test_few_components_meet_by_arcs(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, dim)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df) == want(rows)
    unit = capsearch._unit(rng.standard_normal((4000, 2)))
    row, arc = capsearch.Caps(2, 4000).decode(unit)
    assert np.bincount(arc).max() < 0.2 * len(row)


def test_workers_draw_the_codes_they_are_told_to():
    one = capsearch.Caps(16, 3000)
    two = capsearch.Caps(16, 3000, n_codes=len(one.codes))
    assert len(two.codes) == len(one.codes) and all((a == b).all() for x, y in zip(one.codes, two.codes) for a, b in zip(x, y))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16).tolist()
    rows = [
        (5, base), (3, base), (3, base), (9, [2 * v for v in base]), (1, [-v for v in base]), (2, None), (4, []),
        (6, [0.0] * 16), (7, [float("nan")] * 16), (8, [float("inf")] + base[1:]), (10, [None] + base[1:]),
        (None, base), (11, base[:8]), (12, base[:8]), (13, [1e-300 * v for v in base]), (14, [1e300 * v for v in base]),
        (15, [-0.0, 1.0]), (16, [0.0, 1.0]), (17, [3.0]), (18, [4.0]), (19, [-4.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rep int, v string")
    assert result(df) == want(rows)
    assert result(df.limit(0)) == []


@pytest.mark.parametrize("block", [7, 50])
def test_crowded_filters_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(capsearch, "BLOCK", block)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + 0.12 * rng.standard_normal(24)).tolist()) for i in range(150)]
    rows += [(1000 + i, rng.standard_normal(24).tolist()) for i in range(50)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df) == want(rows)


@pytest.mark.parametrize("dim, n_vectors", [(64, 50_000), (64, 500_000), (64, 3_000_000), (64, 10_000_000), (8, 3_000_000), (3, 50_000)])
def test_recall_holds_at_every_size(dim, n_vectors):
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, 3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    own = capsearch.caps(dim, n_vectors)
    passed = []
    for v in (x, y):
        row, found = own.decode(v)
        assert len(np.unique(row)) == len(v)  # none without a filter
        passed.append(set(zip(row.tolist(), found.tolist())))
    met = len({row for row, _ in passed[0] & passed[1]})
    print(dim, n_vectors, len(own.codes), own.size, met / 3000, own.missed)
    assert met >= 0.998 * 3000
