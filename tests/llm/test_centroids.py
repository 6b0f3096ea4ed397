"""Centroid clustering against plain integers, the screening's intervals, the SQL twin and odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gatework.llm import sql
from gatework.llm.centroids import cluster, intervals, nearest, whole
from gatework.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(np.floor(np.float64(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [min((dist(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda j: sum(d for d, c in at if c == j)
    return sorted(((i, c, d, of(c), sum(d for d, _ in at), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_twin(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    df = QUERIES["op13_centroid_clustering"](spark, path)
    columns = ", ".join(df.columns)
    assert answer(df) == sorted(con.sql(f"SELECT {columns} FROM ({sql.OP13})").fetchall(), key=str)


def test_plain_on_ties_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-2, 3, 64) / 64).tolist()) for i in range(60)]
    rows += [(100, [0.5] * 64)] * 40 + [(None, [0.25] * 64), (None, [-0.25] * 64), (200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as cluster", "2 as v", "3 as distance")
    assert answer(cluster(df)) == plain(rows)


def test_few_and_none(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.3, -0.4]), (3, [5.0, 5.0])]
    assert answer(cluster(spark.createDataFrame(rows, SCHEMA), dim=2)) == plain(rows, dim=2)
    empty = cluster(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 27), st.integers(1, 9), st.randoms(use_true_random=False))
def test_intervals_hold_the_exact_score(dim, bits, k, random):
    most = min(2**bits, int(2**31 / dim**0.5) // 2)
    v = np.array([[random.randint(-most, most) for _ in range(dim)] for _ in range(12)])
    c = np.array([[random.randint(-most, most) for _ in range(dim)] for _ in range(k)])
    c[-1] = c[0]
    v[0] = c[0]
    low, high = intervals(v, c)
    for i in range(len(v)):
        for j in range(k):
            exact = sum(int(y) ** 2 - 2 * int(x) * int(y) for x, y in zip(v[i], c[j], strict=True))
            assert low[i, j] <= exact <= high[i, j]
    best, d, _ = nearest(v, c)
    want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)), j) for j, b in enumerate(c)) for a in v]
    assert list(zip(d.tolist(), best.tolist(), strict=True)) == want


def test_near_ties_are_looked_at_again():
    c = np.array([[3_000_000, 1], [3_000_001, 0]])
    v = np.array([[3_000_000, 0], [3_000_001, 1], [-3_000_000, 5]])
    best, d, unsure = nearest(v, c)
    assert unsure >= 2 and best.tolist() == [0, 0, 0] and d.tolist() == [1, 1, 6_000_000**2 + 16]


def test_too_large_is_an_error():
    assert whole(np.array([[-0.01, 1.99]]), 64).tolist() == [[-1, 127]]
    with pytest.raises(OverflowError):
        whole(np.array([[1e12] * 64]), 64)
