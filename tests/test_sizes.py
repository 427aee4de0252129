"""What the third round's findings named: small cases that failed before."""

import ast
import datetime
import inspect

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunk, dense, evaluate, graph, sparse
from quarry.plans import queries


def test_job_state_of_given_events(spark, tmp_path):
    """Its table of states is its own, and ids beyond the doubles keep their job."""
    at, big = datetime.datetime(2024, 1, 1), (1 << 53) + 4
    rows = [(0, at, "view"), (1, at, "click"), (2, at, "purchase"), (4, at, "error"), (7, at, "signup"), (big + 3, at, "view"), (big + 4, at, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in queries.job_state(spark, str(tmp_path)).collect()}
    assert got == {(0, "succeeded", "succeeded"), (1, "cancelled", "cancelled"), (big // 4, "running", "running"), (big // 4 + 1, "queued", "queued")}


def test_no_name_is_given_twice():
    """A second table of a name would replace what earlier queries read when they run."""
    names = [t.id for n in ast.parse(inspect.getsource(queries)).body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
    assert len(names) == len(set(names))


def test_job_state_of_events_without_time(spark, tmp_path):
    """DuckDB's order puts a missing time last, so such an event is the last one."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(0, at, "view"), (1, None, "click"), (4, None, "view"), (5, None, "error"), (6, at, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = set(con.execute(queries.ORACLES["job_state"]).fetchall())
    assert {tuple(r) for r in queries.job_state(spark, str(tmp_path)).collect()} == want == {(0, "running", "queued"), (1, "failed", "failed")}


def test_graph_of_islands(spark, tmp_path):
    """More close rows together than a node has neighbours: the graph falls apart, the search still finds nine of ten."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(30, 16)), 40, axis=0) + rng.normal(scale=0.05, size=(1200, 16))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = {(r.query_id, r.vec_id) for r in dense.search(v, q).collect()}
    found = {(r.query_id, r.vec_id) for r in graph.Graph.build(v, str(tmp_path / "g")).search(q).collect()}
    assert len(found) == len(best) == 300 and len(best & found) >= 270


def test_rows_of_a_list_come_together(spark):
    """Lists spread over many partitions make a block each, and blocks send on the k best as a full sort has them."""
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"), (F.col("id") % 7).alias("list_id")).repartition(20)
    assert dense._blocks(v, "vec_id", "embedding", ["list_id"], 2048, True).count() == 7
    rng = np.random.default_rng(4)
    s = rng.integers(0, 4, (50, 90)).astype(float)
    s[3] = -np.inf
    s[4, 5:] = np.nan
    ids = rng.permutation(90)
    row, col = dense.best_of(s, ids, 10)
    want = [(i, j) for i in range(50) for j in sorted((j for j in range(90) if np.isfinite(s[i, j])), key=lambda j: (-s[i, j], ids[j]))[:10]]
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == want


def test_counts_are_rows_of_ids(spark, tmp_path):
    """Repeated ids, null ids and texts, camel case; no row is a token, nothing is aggregated, and postings take no exchange."""
    rows = [(1, "parseHTTPRequest server Server"), (1, "server config"), (2, "the of"), (3, None), (None, "x1 config"), (None, "config"), (4, "config " * 5000)]
    docs = spark.createDataFrame(rows, "id long, content string").repartition(3)
    words = docs.select("id", F.explode(T.tokenize("content")).alias("t"))
    want = {(r.id, r.n, r.m) for r in words.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("t").alias("m")).collect()}
    counts = sparse.counted(docs, "id", "content")
    assert {(r.id, r.n_tokens, r.n_terms) for r in counts.where("n_tokens > 0").collect()} == want and counts.count() == 5
    tf = {tuple(r) for r in words.select("id", T.term_hash("t").alias("h")).groupBy("id", "h").count().collect()}
    assert {tuple(r) for r in sparse.frequencies(docs, "id", "content").collect()} == tf
    assert "Aggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    model = sparse.Bm25.stored(docs, str(tmp_path / "m"))
    assert model.stats.first().n == 7 and model.df.where(F.col("term_hash") == sparse.hashed("config")).first().df == 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        q = model.asked(spark.createDataFrame([(1, "server config")], "query_id int, text string"))
        plan = sparse.dot(model.postings(), q)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange hashpartitioning" not in plan and "Arrow" not in plan


def test_recall_without_pairs(spark, sf):
    """The same as with the table of all relevant pairs, which the plan no longer makes."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    truth = q.select("query_id", "label").join(v.select("vec_id", "label"), "label").select("query_id", "vec_id")
    hits = dense.search(v, q)
    want = {tuple(r) for r in evaluate.recall(hits, truth, "query_id", "vec_id").collect()}
    assert {tuple(r) for r in queries.recall_at_k(spark, sf).collect()} == want
    some = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "query_id long, vec_id long")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "z")], "query_id long, label string")
    rows = spark.createDataFrame([(7, "a"), (8, "a"), (9, "a"), (9, "a"), (10, "b"), (11, None)], "vec_id long, label string")
    got = {tuple(r) for r in evaluate.recall_within(some, asked, rows, "label", "query_id", "vec_id").collect()}
    assert got == {(1, 0.5), (2, 0.0), (3, 0.0)}


def test_chunks_come_in_slices(spark, monkeypatch):
    """A task gives its chunks on while it reads, and they are those of each text alone."""
    monkeypatch.setattr(chunk, "SLICE", 50_000)
    texts = ["a line\n" * 700, None, "", "x" * 9000, "é" * 4000 + "\nend", *[f"{i}\n" * (i % 90) for i in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    got = sorted(tuple(r) for r in chunk.capped(docs, "id", "content").collect())
    assert got == sorted((i, k, *c) for i, t in enumerate(texts) for k, c in enumerate(chunk.pack_lines(t or "")))
    assert "MapInArrow" in chunk.capped(docs, "id", "content")._jdf.queryExecution().executedPlan().toString()
