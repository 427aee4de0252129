"""Whitening against plain numpy over whole columns and against exact whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import whitening
from quarry.llm.queries import op12_whitening


def plain(rows):
    """{vec_id: (deviation, {component: |whitened|})}, n and explained of rows (id, vector of doubles)."""
    x = [[int(np.floor(64 * v)) + 1_000_000 for v in vec] for _, vec in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:32], axes[:, ::-1][:, :32]
    dev = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    return n, dev, centred @ axes / np.sqrt(np.where(e > 0, e, np.nan)), e / np.trace(cov)


def held(out, rows, tie=1e-9):
    n, dev, z, explained = plain(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows)
    flip = {}
    for i, (name, _) in enumerate(rows):
        assert sorted(got[name]) == list(range(1, z.shape[1] + 1))
        for c, r in got[name].items():
            assert r.n == n and r.deviation == dev[i] and r.identity_error <= 1e-4
            assert abs(r.explained - explained[c - 1]) <= 1e-9 * explained[c - 1]
            if c not in flip:
                flip[c] = 1 if r.whitened * z[i, c - 1] >= 0 or abs(z[i, c - 1]) < 1e-3 else -1
            assert abs(r.whitened * flip[c] - z[i, c - 1]) < 1e-6


def test_given_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None]
    out = op12_whitening(spark, sf)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    held(out, rows)
    z = np.array([r.whitened for r in out.orderBy("component", "vec_id").collect()]).reshape(32, len(rows))
    assert np.abs(z @ z.T / len(rows) - (z.mean(1)[:, None] * z.mean(1)) - np.eye(32)).max() < 1e-8


SCHEMA = "vec_id long, embedding array<float>, label int"


def odd(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(parts)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in np.float32(rng.normal(size=5) * [1, 3, 9, 27, 81])]) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [1.0, nan, 2.0, 3.0, 4.0]), (903, [1.0, inf, 2.0, 3.0, 4.0]), (904, []), (905, [1.0, 2.0]), (906, [-inf] * 5)]
    df = odd(spark, good + bad)
    for c in ("n", "component", "whitened", "v", "size", "count", "deviation"):
        df = df.withColumn(c, F.lit("clash"))
    held(whitening.whiten(df), good)


def test_no_variance_repeated_rows_and_empty(spark):
    one = whitening.whiten(odd(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    rows = [(None, [0.0, 5.0, 1.0]), (7, [0.0, 5.0, 1.0]), (7, [0.0, 6.0, 2.0]), (8, [0.0, 9.0, 5.0])]
    out = whitening.whiten(odd(spark, rows)).collect()
    assert len(out) == 12 and all((r.whitened is None) == (r.component > 1) for r in out) and {r.identity_error < 1e-9 for r in out} == {True}
    assert sorted(r.vec_id is None for r in out) == [False] * 9 + [True] * 3
    assert whitening.whiten(odd(spark, [])).count() == 0
    assert whitening.whiten(odd(spark, [(1, []), (2, None)])).count() == 0
    assert whitening.whiten(odd(spark, [(1, [1.0]), (2, [1.0, 2.0])])).count() == 2  # equally common: the longest


def test_far_from_zero_and_too_large(spark):
    """A mean much larger than the spread, and numbers whose squares no long holds."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.float32(1e5 + rng.normal(size=3) * [1, 2, 4])]) for i in range(50)]
    held(whitening.whiten(odd(spark, rows)), rows)
    huge = [(i, [float(np.float32(1e30 * (i % 3))), float(i)]) for i in range(6)]
    out = whitening.whiten(odd(spark, huge)).collect()
    assert len(out) == 12 and all(r.deviation is None for r in out if r.vec_id % 3 != 1) and all(r.identity_error < 1e-4 for r in out)


@pytest.mark.parametrize("parts", [1, 7])
def test_merge_equals_whole(parts):
    x = np.random.default_rng(6).integers(-1000, 1000, size=(997, 6)) + 10**9
    have = (0, np.zeros(1), np.zeros((1, 1)))
    for p in np.array_split(x, parts):
        have = whitening.merge(have, whitening.gathered(p))
    assert have[0] == 997 and list(have[1]) == x.sum(axis=0).tolist()
    away = x - x.mean(axis=0)
    assert np.allclose(have[2], away.T @ away, rtol=1e-11)
