"""Whitening against plain numpy and exact integers, on odd tables too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwarden.llm import queries
from cardwarden.llm.whitening import whiten

KIND = "vec_id long, embedding array<float>, n int, deviation string"


def _expected(vectors, k):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    dev = [d if d < 1 << 63 else None for d in dev]
    return n, dev, (c @ v / np.sqrt(e))[:, :k], (e / e.sum())[:k]


def _check(rows, ids, vectors, k):
    n, dev, white, share = _expected(vectors, k)
    assert len(rows) == len(ids) * k
    at = {i: j for j, i in enumerate(ids)}
    got = np.zeros((len(ids), k))
    for r in rows:
        j = at[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == dev[j] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9)
        got[j, r["component"] - 1] = r["whitened"]
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-6


def test_query_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, sf_dir).collect()
    _check(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table], 8)


def test_ill_conditioned_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 6)) * np.array([4000.0, 100, 8, 1, 0.3, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    vectors = vectors.astype(np.float32).astype(float).tolist()
    odd = [None, [], [1.0, 2.0], [None] + [0.0] * 5, [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1e30] + [0.0] * 5]
    rows = list(enumerate(vectors)) + [(9000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND).repartition(7)
    out = whiten(df)
    assert out.columns[:3] == ["vec_id", "component", "n"]
    _check(out.collect(), list(range(3000)), vectors, 6)


def test_singular_repeated_and_empty(spark):
    # Two equal columns and a constant one: two components carry all variance.
    base = [[float(i % 7), float(i % 7), 5.0, float(i % 3)] for i in range(200)]
    df = spark.createDataFrame([(1, v, 0, "") for v in base] + [(None, base[0], 0, "")], KIND)
    rows = whiten(df).collect()
    assert len(rows) == 201 * 4
    assert all((r["whitened"] is None) == (r["component"] > 2) for r in rows)
    assert {r["explained"] for r in rows if r["component"] > 2} == {0.0}
    assert max(r["identity_error"] for r in rows) < 1e-9
    same = whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(5)], KIND)).collect()
    assert len(same) == 10 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(None, 0.0, 0, None)}
    assert whiten(df.where("false")).count() == 0
    assert whiten(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(0, [0.0, 1e9], 0, ""), (1, [3.0, -1e9], 0, ""), (2, [1.0, 0.0], 0, "")], KIND)
    got = {r["vec_id"]: r["deviation"] for r in whiten(df).collect()}
    n, dev, _, _ = _expected([[0.0, 1e9], [3.0, -1e9], [1.0, 0.0]], 2)
    assert None in dev and got == dict(enumerate(dev))
