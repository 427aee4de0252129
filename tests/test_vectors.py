"""Vector indexes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, graph, vectors


@pytest.fixture(scope="module")
def table(spark, sf):
    v = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    return v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def clustered(spark, n=3000, width=16, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, width))
    x = centres[r.integers(0, 20, n)] + r.normal(size=(n, width)) * 0.25
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)] + [(n, None, "x"), (n + 1, [], "x"), (n + 2, [1.0], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list_id string").repartition(5)


def pairs(df):
    return sorted((r.query_id, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("least", [0.3, 0.8, 0.95])
def test_radius_on_lists_loses_nothing(spark, table, tmp_path, least):
    v, q = table
    lists = vectors.Lists.build(v, str(tmp_path / "l"))
    assert lists.rows.count() == v.count() and sum(n for n, _ in lists.radii.values()) == v.count()
    assert pairs(lists.radius(q, least)) == pairs(dense.search(v, q, None, least=least).drop("tag"))


def test_radius_reads_fewer_lists(spark, tmp_path):
    v = clustered(spark)
    q = v.where("vec_id % 100 = 0 and size(embedding) > 1").select(F.col("vec_id").alias("query_id"), "embedding")
    lists = vectors.Lists.build(v, str(tmp_path / "l"))
    want = pairs(dense.search(v.where("size(embedding) = 16").select("vec_id", "embedding"), q, None, least=0.9))
    assert pairs(lists.radius(q, 0.9)) == want and len(want) > 1000
    assert lists.share_read(q, 0.9) < 0.5


def test_lists_of_an_empty_table(spark, tmp_path):
    v = clustered(spark, 5).limit(0)
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert vectors.Lists.build(v, str(tmp_path / "l")).radius(q, 0.5).collect() == []
    assert vectors.Codes.build(v, str(tmp_path / "c")).search(q).collect() == []


def test_inner_products_by_distance(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 7)) * r.uniform(0.1, 5, size=(400, 1))
    v = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(x)] + [(400, [0.0] * 7)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert pairs(vectors.inner_products(v, q)) == pairs(dense.search(v, q, metric="ip").drop("tag"))


def test_codes(spark, table, tmp_path):
    """Sixteen bytes for 64 components; ten times ten candidates hold nearly all of the ten nearest."""
    v, q = table
    best = {(a, b) for a, b, _ in pairs(dense.search(v, q))}
    codes = vectors.Codes.build(v, str(tmp_path / "c"))
    assert codes.rows.count() == v.count() and {r[0] for r in codes.rows.select(F.length("code")).distinct().collect()} == {16}
    found = codes.search(q).collect()
    assert len(best & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(best) and len(found) == len(best)
    odd = clustered(spark, 300, 5)
    few = odd.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    codes = vectors.Codes.build(odd, str(tmp_path / "d"))
    assert {r[0] for r in codes.rows.select(F.length("code")).distinct().collect()} == {2} and len(codes.search(few, 5).collect()) == 15


def test_graph(spark, table, tmp_path):
    """Nine of ten nearest are found, and fewer rows are compared than lists would ask for."""
    v, q = table
    best = {(a, b) for a, b, _ in pairs(dense.search(v, q))}
    g = graph.Graph.build(v, str(tmp_path / "g"))
    assert g.rows.count() == v.count() and g.edges.where("size(near) <> 16 or array_contains(near, node)").isEmpty()
    found = {(r.query_id, r.vec_id) for r in g.search(q).collect()}
    assert len(best & found) >= 0.9 * len(best) and len(found) == len(best)
    compared = g.search(q, seen=True).count() / q.count()
    ivf = dense.Ivf(v)
    asked = ivf.filed(q, ivf.probes).join(ivf.rows.groupBy("list_id").count(), "list_id").agg(F.sum("count")).first()[0] / q.count()
    assert compared < asked


def test_graph_on_odd_rows(spark, tmp_path):
    v = clustered(spark, 200, 4)
    copies = v.union(v.where("vec_id < 60").withColumn("vec_id", F.col("vec_id") + 1000))
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = graph.Graph.build(copies, str(tmp_path / "g"), degree=6).search(q, 3).collect()
    assert len(got) == 15 and all(r.score == 1 for r in got if r["rank"] <= 2)
    none = v.limit(0)
    assert graph.Graph.build(none, str(tmp_path / "e")).search(q, 3).collect() == []
