"""Eigenvectors against numpy's; whitening against a plain version, on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def matrices():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 150):
        x = r.standard_normal((3 * n + 1, n))
        yield x.T @ x / len(x)
        yield (x * np.geomspace(1, 1e-5, n)).T @ (x * np.geomspace(1, 1e-5, n)) * 1e6
        yield np.eye(n) * 2.5
        yield np.diag(np.repeat([3.0, 1.0], [n - n // 2, n // 2]))
        yield np.zeros((n, n))
        q, _ = np.linalg.qr(x[:n])
        yield q @ np.diag(1 + np.repeat([1e-9, 0.0], [n - n // 2, n // 2])) @ q.T


@pytest.mark.parametrize("a", matrices())
def test_components_equal_numpy(a):
    values, vectors = whitening.components(a, 8)
    want = np.linalg.eigvalsh((a + a.T) / 2)[::-1][: len(values)]
    size = max(np.abs(a).max(), 1e-300)
    assert len(values) == min(8, len(a)) and np.abs(values - want).max() < 1e-13 * size * len(a)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def plain(vectors, k=8):
    x = np.floor(np.array(vectors, dtype="float32").astype(float) * 1024).astype("int64") + 100_000
    n, s = len(x), x.sum(0)
    own = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    c = x - s / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return own, np.abs(c @ axes / np.sqrt(values)), values / np.trace(v)


def test_whitening_equals_plain_version(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(12) * np.geomspace(3, 0.2, 12)).astype("float32").tolist()) for i in range(500)]
    good = [v for _, v in rows]
    bad = [(900, None), (901, [float("nan")] + [0.0] * 11), (902, [float("inf")] + [0.0] * 11), (903, [0.0] * 11), (904, [])]
    docs = spark.createDataFrame(rows + bad, SCHEMA).withColumn("x", F.lit("mine")).withColumn("n", F.lit(0)).repartition(5)
    docs = docs.unionByName(docs.filter("vec_id = 900").drop("embedding").withColumn("embedding", F.array(F.lit(None).cast("float"), *(F.lit(0.0).cast("float") for _ in range(11)))))
    own, white, explained = plain(good)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(docs).collect()}
    assert len(got) == 500 * 8
    for i in range(500):
        for k in range(8):
            g = got[i, k + 1]
            assert (g["n"], g["deviation"]) == (500, own[i]) and abs(g["whitened"]) == pytest.approx(white[i, k], abs=1e-9)
            assert g["explained"] == pytest.approx(explained[k], rel=1e-10) and g["identity_error"] < 1e-12


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0
    assert make([(1, [1.0, 2.0])]).count() == 0 and make([(i, [1.0, 2.0]) for i in range(9)]).count() == 0  # no variance
    line = make([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]).collect()  # rank 1 of 3
    assert {r["component"] for r in line} == {1} and len(line) == 6 and line[0]["explained"] == pytest.approx(1) and line[0]["identity_error"] < 1e-12
    twice = make([(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 3.0]), (8, [2.0, -1.0])])
    assert twice.count() == 8 and twice.filter("vec_id = 7").count() == 4 and twice.filter("vec_id is null").count() == 2
    far = make([(0, [2.0**32, 0.0]), (1, [-(2.0**32), 1.0]), (2, [0.0, 2.0])])
    assert far.filter("deviation is null").count() == 2 * far.select("component").distinct().count()  # beyond 64 bits


def test_deviations_are_exact_at_any_size():
    x = np.array([[2**43, 5], [-(2**40), 7], [3, 2**41]], dtype="int64")
    total = [int(v) for v in x.sum(0)]
    want = [sum((3 * int(v) - t) ** 2 for v, t in zip(row, total)) for row in x]
    assert whitening.deviations(x, 3, total) == [v if v < 1 << 63 else None for v in want]
    small = np.array([[100_100, 99_000], [100_000, 100_001]], dtype="int64")
    assert whitening.deviations(small, 2, [200_100, 199_001]) == [100**2 + 1001**2] * 2
