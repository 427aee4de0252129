"""Operators on small frames: chunks, collection, manifest, catalog, fusion, evaluation, streams."""

import json
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.operators import catalog, chunk, collection, dense, evaluate, filters, fusion, index, manifest, render, sparse
from quarry.sources import embed, files
from quarry.streaming import watch


@given(st.text(alphabet="ab é\n", max_size=200), st.integers(3, 40), st.integers(1, 5))
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_packed_lines_are_the_text(text, most_bytes, most_lines):
    parts = chunk.pack_lines(text, most_bytes, most_lines)
    out = ""
    for k, (start, end, part, content) in enumerate(parts):
        assert len(content.encode()) <= most_bytes and start <= end
        out += content if part or k == 0 else "\n" + content
    assert out == text


def test_line_chunks(spark):
    df = spark.createDataFrame([(1, "line1\nline2\nline3\n"), (2, "")], "id int, text string")
    got = [tuple(r) for r in chunk.by_lines(df, "id", "text", 2).orderBy("id", "chunk_no").collect()]
    assert got == [(1, 0, 1, 2, "line1\nline2"), (1, 1, 3, 4, "line3\n"), (2, 0, 1, 1, "")]


SOURCES = {
    "a.go": ("package x\n\nfunc add(a int) int {\n\treturn a\n}\n\nfunc main() {\n}\n", ["add", "main"]),
    "a.py": ("import os\n\ndef f():\n    pass\n\n@dec\nclass C:\n    def g(self): pass\n", ["f", "C"]),
    "a.rb": ("class A\n  def b\n  end\nend\n", ["A"]),
    "a.sql": ("CREATE TABLE t (a int);\nSELECT 1;\n", ["t", ""]),
    "Dockerfile": ("FROM x\nRUN y\n", ["", ""]),
    "a.txt": ("one\ntwo", ["a.txt:1-2"]),
    "bad.py": ("def f(:\n", ["bad.py:1-2"]),
    "e.go": ("", ["e.go:1-1"]),
}


def test_definitions(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in SOURCES.items()], "path string, content string")
    got = {}
    for r in chunk.chunks(df).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append(r.name)
    assert got == {k: v[1] for k, v in SOURCES.items()}
    big = spark.createDataFrame([("b.go", "func f() {\n" + "\tx()\n" * 2000 + "}\n")], "path string, content string")
    parts = chunk.chunks(big).collect()
    assert len(parts) > 1 and all(len(p.chunk) <= 3000 for p in parts) and parts[0].name == "f (part 1)"


def points(spark, rows):
    return spark.createDataFrame(rows, "id int, source_file string, v string")


def test_writes(spark):
    p = points(spark, [(1, "a", "x"), (2, "a", "y"), (3, "b", None)])
    fresh = points(spark, [(2, "a", "new"), (4, "c", "z")])
    once = collection.upsert(p, fresh)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, collection.upsert(once, fresh).collect()), key=str)
    assert {r.id: r.v for r in once.collect()} == {1: "x", 2: "new", 3: None, 4: "z"}
    assert {r.id for r in collection.delete_files(p, p.where("source_file = 'a'")).collect()} == {3}
    assert {r.id for r in collection.delete_ids(p, p.where("id = 1")).collect()} == {2, 3}
    assert {r.id for r in collection.replace_files(p, points(spark, [(9, "a", "n")])).collect()} == {3, 9}
    changed = collection.update(p, spark.createDataFrame([(1, None), (3, "w"), (8, "q")], "id int, v string"))
    assert {r.id: r.v for r in changed.collect()} == {1: "x", 2: "y", 3: "w"}
    feed = spark.createDataFrame([(1, "f", "n", "upsert", 1), (1, "f", "n", "delete", 2), (7, "g", "m", "upsert", 3)], "id int, source_file string, v string, op string, seq int")
    assert {r.id for r in collection.apply_changes(p, feed).collect()} == {2, 3, 7}


def test_browse(spark):
    p = spark.range(60).select(F.col("id").cast("int"), F.lit("f").alias("source_file"))
    assert [r.id for r in collection.page(p, 3, 25, F.col("id")).collect()] == list(range(50, 60))
    assert collection.page(p, 4, 25, F.col("id")).collect() == [] and collection.page(p, 0, 25, F.col("id")).count() == 25
    assert [r.id for r in collection.scroll(p, 49, 5).collect()] == [50, 51, 52, 53, 54] and collection.scroll(p).count() == 50
    seen, last = [], None
    while rows := collection.scroll(p, last, 7).collect():
        seen += [r.id for r in rows]
        last = rows[-1].id
    assert seen == list(range(60))


@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xyz")), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xyz")))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_diff_is_a_partition(spark, now, before):
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string")
    got = {r.path: r.change for r in manifest.diff(frame(now), frame(before)).collect()}
    assert got == {p: "added" if p not in before else "deleted" if p not in now else "unchanged" if now[p] == before[p] else "modified" for p in {*now, *before}}
    after = {r.path: r.sha256 for r in manifest.apply(frame(before), frame(now), frame(now | before)).collect()}
    assert after == now


def test_plan(spark):
    d = spark.createDataFrame([(f"p{i}", "unchanged" if i > 2 else "modified") for i in range(10)], "path string, change string")
    row = manifest.plan(d, 5).first()
    assert (row.changes, row.mode, row.sync) == (3, "delta", True)
    assert manifest.plan(d, 0).first().mode == "full" and manifest.plan(d.where("change = 'unchanged'"), 5).first().mode == "none" and manifest.plan(d.where("change = 'modified'"), 5).first().mode == "full"


def test_catalog(spark):
    projects = spark.createDataFrame([(1, "a", "/X/y/", "m", "code"), (2, "1", "/z", "", "code")], "id long, name string, root_path string, machine_id string, domains string")
    assert catalog.resolve(projects, "1").first().name == "a" and catalog.resolve(projects, "a").first().id == 1
    assert catalog.by_path(projects, "m", "\\x\\y").first().id == 1 and catalog.by_path(projects, "other", "/x/y").first() is None and catalog.by_path(projects, "q", "/z").first().id == 2
    more = catalog.insert_project(projects, {"id": 3, "name": "c", "root_path": "/c", "machine_id": "m"})
    assert more.where("id = 3").first().domains == "code"
    with pytest.raises(ValueError):
        catalog.insert_project(projects, {"id": 4, "name": "a"})
    left, pts = catalog.delete_project(projects, spark.createDataFrame([("a",), ("b",)], "project string"), "a")
    assert left.count() == 1 and [r.project for r in pts.collect()] == ["b"]
    with pytest.raises(KeyError):
        catalog.delete_project(projects, projects, "zz")
    models = catalog.merge_models(spark.createDataFrame([("m1", 1)], "name string, dim int"), spark.createDataFrame([("m1", 2), ("m2", 3), ("m2", 3)], "name string, dim int"))
    assert sorted(map(tuple, models.collect())) == [("m1", 1), ("m2", 3)]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "parseConfig loads config"), (2, "server parser"), (3, "")], "id int, content string")
    m = sparse.Bm25(docs)
    s = m.stats.first()
    assert s.n == 3 and s.avgdl == pytest.approx(6 / 3)
    q = m.query(spark.createDataFrame([(1, "config unknownword"), (2, "")], "query_id int, text string"))
    assert {r.query_id for r in q.collect()} == {1} and min(r.weight for r in q.collect()) == pytest.approx(0.1)
    hits = sparse.top_k(sparse.dot(m.postings(), q), 5, "query_id", "id").collect()
    assert [(r.id, r["rank"]) for r in hits] == [(1, 1)]
    assert sparse.match_all(m.postings(), q).collect() == []
    m.close()


def test_dense(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8))
    v = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(300)], "vec_id long, embedding array<double>, label int").repartition(5)
    q = v.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = dense.search(v, q, k=7, per=37).collect()
    for i in range(4):
        s = np.round(unit @ unit[i], 6)
        want = sorted(range(300), key=lambda j: (-s[j], j))[:7]
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == i), key=lambda g: g["rank"])] == want
    small = {(g.query_id, g.vec_id) for g in dense.quantised_search(v, q, 5).collect()}
    ivf = {(g.query_id, g.vec_id) for g in dense.Ivf(v, 8).search(q, 5, probes=8).collect()}
    best = {(g.query_id, g.vec_id) for g in got if g["rank"] <= 5}
    assert len(small & best) >= 19 and ivf == best
    assert all(g.vec_id % 3 == g.query_id % 3 for g in dense.search(v, q, k=7, same=("label",)).collect())


def test_index_recall(spark, sf):
    v = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = {(r.query_id, r.vec_id) for r in dense.search(v, q).collect()}
    index = dense.Ivf(v)
    assert index.rows.count() == v.count()
    for found in (index.search(q), dense.quantised_search(v, q)):
        assert len(best & {(r.query_id, r.vec_id) for r in found.collect()}) >= 0.9 * len(best)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id int, id int, score double, rank int")
    b = spark.createDataFrame([(1, 11, 7.0, 1), (1, 12, 3.0, 2)], "query_id int, id int, score double, rank int")
    assert [(r.id, r.score) for r in fusion.rrf([a, b], 2).orderBy("rank").collect()] == [(11, 0.833333), (10, 0.5), (12, 0.333333)]
    assert [(r.id, r.score) for r in fusion.weighted([a, b], [0.5, 0.5]).orderBy("rank").collect()] == [(10, 0.5), (11, 0.5), (12, 0.0)]
    assert [r.id for r in fusion.rrf([a, b.where("false")], 2).orderBy("rank").collect()] == [10, 11]
    assert fusion.prefetch(5) == 20 and fusion.prefetch(10) == 30


def test_percentiles(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in [5, 1, 3, 3, 9, 7, 2, 8, 4, 6]], "g string, v double")
    s = sorted([5, 1, 3, 3, 9, 7, 2, 8, 4, 6])
    place = {"nearest": lambda p: -(-10 * p // 100) - 1, "coded": lambda p: min(9, (10 * p + 99) // 100), "floor": lambda p: 9 * p // 100}
    for rule, at in place.items():
        got = evaluate.latencies(rows, "v", ["g"], rule=rule).first()
        other = rows.agg(*[evaluate.percentile(F.array_sort(F.collect_list("v")), p, rule).alias(f"p{p}") for p in (50, 95, 99)]).first()
        assert [got[f"p{p}"] for p in (50, 95, 99)] == [s[at(p)] for p in (50, 95, 99)] == list(other)


def test_recall_and_render(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.25)], "query_id int, id string, rank int, score double")
    truth = spark.createDataFrame([(1, "a"), (1, "z"), (2, "q")], "query_id int, id string")
    assert {r.query_id: r.recall for r in evaluate.recall(hits, truth).collect()} == {1: 0.5, 2: 0.0}
    text = render.context(hits, render.context_line(F.col("score"), F.col("id"), F.lit(1), F.lit(9), F.lit("n")), F.lit("body")).first().context
    assert text == "[score 0.500] a:1-9 (n)\nbody\n\n[score 0.250] b:1-9 (n)\nbody"


def test_walk_and_snapshots(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a.go": "x", "node_modules/b.go": "x", "d/c.py": "y", "d/skip.log": "z", "d/blank.py": " ", "img.png": "p", ".hid/x.go": "q"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    got = files.walk(spark, str(root))
    assert sorted(r.path for r in got.collect()) == ["a.go", "d/c.py"]
    assert sorted(r.path for r in files.walk(spark, str(root), exclude=("d/**",), content=False).collect()) == ["a.go"]
    files.save_snapshot(got.select("path", "sha256"), str(tmp_path / "snap"))
    assert files.load_snapshot(spark, str(tmp_path / "snap")).count() == 2 and files.load_snapshot(spark, str(tmp_path / "none")) is None
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "query": "x", "relevant_files": ["a"]}, {"id": "2", "query": "y", "relevant": ["b"]}]))
    assert [r.relevant for r in files.dataset(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()] == [["a"], ["b"]]


def test_embedders(spark):
    df = spark.createDataFrame([("x y",), (None,)], "content string")
    assert all(len(r.embedding) == 64 for r in embed.embed(df, "hashing").collect())
    with pytest.raises(ValueError):
        embed.embedder("none")
    vec = embed.hash_embedding(spark.createDataFrame([(1, "alpha beta alpha")], "id int, text string"), "id", "text").first().embedding
    assert len(vec) == 64 and sum(x * x for x in vec) == pytest.approx(1)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_type").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = watch.quiet_periods(stream, "4 hours", "1 hour", key="user_id", path="event_type")
    q = out.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {(r.user_id, r.start, r.n) for r in spark.table("bursts").collect()}
    batch = {(r.user_id, r.start, r.n) for r in watch.quiet_periods(events, "4 hours", key="user_id", path="event_type").collect()}
    assert streamed <= batch and len(streamed) > 0.9 * len(batch)
    seen = []
    watch.into_batches(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "ck2")).awaitTermination()
    assert sum(seen) == events.count()


@pytest.mark.parametrize("text", ["java_method('java.lang.System', 'exit')", "a = upper(b)", "a =", "a = 1 b", "(a = 1", "a in ()", "a like", "a = b", "not", "a between 1", "a ; b", "reflect('x','y') = 1", "a is 3"])
def test_store_filter_takes_no_functions(spark, text):
    with pytest.raises(ValueError, match="filter"):
        filters.store_filter(text)


def test_store_filter_rows(spark):
    df = spark.createDataFrame([(1, "x && y", None), (2, 'say "hi"', True), (3, "z", False)], "a int, b string, c boolean")
    ask = lambda text: sorted(r.a for r in df.where(filters.store_filter(text)).collect())
    assert ask('b = "x && y"') == [1] and ask(r'b = "say \"hi\""') == [2] and ask("c is null || c == true") == [1, 2]
    assert ask("a > 1 and not b like 'z%'") == [2] and ask("a between 2 and 3 and a not in (3)") == [2] and ask("!(a = -1) and a != 2") == [1, 3]


def test_text_query(spark):
    df = spark.createDataFrame([(1, "red green blue"), (2, "green red"), (3, "blue sky"), (4, None)], "i int, t string").withColumn("w", F.split("t", " "))
    ask = lambda text: sorted(r.i for r in df.where(filters.text_query(text, F.col("w"))).collect())
    assert ask("red sky") == [1, 2, 3] and ask('"red green"') == [1] and ask("red AND NOT blue") == [2] and ask("(sky OR red) AND green") == [1, 2]
    assert ask("+green -blue sky") == [2] and ask("the AND red") == [1, 2] and ask("the") == [] and ask("") == []
    for bad in ("(red", "red)", "red AND", "+"):
        with pytest.raises(ValueError, match="query"):
            filters.text_query(bad, F.col("w"))


def test_walk_reads_invalid_bytes(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1 # \xff\n")
    (tmp_path / "b.py").write_bytes("é = 2\n".encode())
    got = {r.path: r.content for r in files.walk(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1 # \ufffd\n", "b.py": "é = 2\n"}


def test_search_on_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], 7), (3, [1.0], 7), (4, None, 7), (5, [], 7), (6, [1.0, 1.0], None)], "vec_id long, embedding array<double>, label int")
    q = v.where("vec_id in (1, 3)").withColumnRenamed("vec_id", "query_id")
    assert sorted((r.query_id, r.vec_id) for r in dense.search(v, q).collect()) == [(1, 1), (1, 2), (1, 6), (3, 3)]
    assert sorted((r.query_id, r.vec_id) for r in dense.search(v, q, same=("label",)).collect()) == [(3, 3)]
    got = sorted((r.query_id, r.label or 0, r.vec_id) for r in dense.search(v, q, k=1, group_col="label").collect())
    assert got == [(1, 0, 1), (1, 7, 2), (3, 7, 3)]
    assert dense.Ivf(v.limit(0)).search(q.limit(0)).collect() == []


def test_fnv(spark):
    def plain(x, h, prime, mask):
        for b in x.encode():
            h = (h ^ b) * prime & mask
        return h

    texts = ["", "a", "naïve", "x" * 300, None, "日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.fnv64(F.col("t")).alias("a"), ids.fnv32_mod(F.col("t"), 65536).alias("b")).collect()
    for r in rows:
        assert (r.a, r.b) == ((None, None) if r.t is None else (f"{plain(r.t, 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1):016x}", plain(r.t, 2166136261, 16777619, (1 << 32) - 1) % 65536))


def test_upsert_of_repeated_keys(spark):
    points = spark.createDataFrame([(1, "old"), (9, "stays")], "id int, v string")
    fresh = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, seq int")
    assert sorted(map(tuple, collection.upsert(points, fresh, seq="seq").collect())) == [(1, "b"), (2, "c"), (9, "stays")]
    assert collection.upsert(points, fresh.drop("seq")).count() == 3


def test_model_writes(spark):
    models = spark.createDataFrame([(1, "one", 64), (2, "two", 32)], "id long, name string, dim int")
    settings = spark.createDataFrame([("active_model_id", "1"), ("other", "x")], "key string, value string")
    assert sorted(r.id for r in catalog.insert_model(models, {"name": "three", "dim": 8}).collect()) == [1, 2, 3]
    assert {r.id: r.dim for r in catalog.update_model(models, {"id": 2, "dim": 99}).collect()} == {1: 64, 2: 99}
    moved = catalog.set_active(models, settings, 2)
    assert sorted(map(tuple, moved.collect())) == [("active_model_id", "2"), ("other", "x")]
    assert [r.id for r in catalog.delete_model(models, settings, 2).collect()] == [1]
    with pytest.raises(ValueError, match="active"):
        catalog.delete_model(models, moved, 2)
    for act in (lambda: catalog.update_model(models, {"id": 7}), lambda: catalog.set_active(models, settings, 7), lambda: catalog.delete_model(models, settings, 7)):
        with pytest.raises(KeyError):
            act()


def test_index_runs(spark):
    rows = lambda *x: spark.createDataFrame([(p, c, f"sha{c}") for p, c in x], "path string, content string, sha256 string")
    project = F.lit("p")
    first = index.full(rows(("a.py", "1\n" * 61), ("b.py", "2"), ("c.py", " ")), project)
    assert sorted((r.source_file, r.start_line, r.end_line) for r in first.points.collect()) == [("a.py", 1, 60), ("a.py", 61, 62), ("b.py", 1, 1)]
    second = index.delta(rows(("a.py", "new"), ("c.py", " "), ("d.py", "4")), first.snapshot, first.points, project)
    assert sorted((r.source_file, r.content) for r in second.points.collect()) == [("a.py", "new"), ("d.py", "4")]
    assert sorted(r.path for r in second.handled.collect()) == ["a.py", "d.py"] and [r.path for r in second.removed.collect()] == ["b.py"]
    assert sorted(r.path for r in second.snapshot.collect()) == ["a.py", "c.py", "d.py"]


@pytest.fixture
def service():
    """A local embedding service: vectors of a text's length, out of order, with one passing failure."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append((self.path, body, self.headers.get("Authorization")))
            if len(calls) == 1 or body["model"] == "bad":
                self.send_response(503 if len(calls) == 1 else 400)
                self.end_headers()
                return
            texts = body.get("texts") or body["input"]
            vectors = [[float(len(t)), 1.0] for t in texts]
            out = {"embeddings": vectors} if "texts" in body else {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


@pytest.mark.parametrize("name", ["llama", "openai", "cohere", "voyage"])
def test_embedding_services(service, name):
    where, calls = service
    texts = ["x" * k for k in range(200)]
    got = embed.embedder(name, endpoint=where + "/", model="m", api_key="k", wait=0.01)(texts)
    assert got[:, 0].tolist() == list(range(200))
    assert calls[0][2] == "Bearer k" and max(len(c[1].get("texts") or c[1]["input"]) for c in calls) <= embed.SERVICES[name].most
    with pytest.raises(RuntimeError, match="400"):
        embed.embedder(name, endpoint=where, model="bad")(["x"])
    with pytest.raises(ValueError, match="length 2"):
        embed.embedder(name, endpoint=where, model="m", dim=3)(["x"])


def test_unknown_embedder():
    with pytest.raises(ValueError, match="cohere"):
        embed.embedder("nothing")
    assert embed.discovered(["gpt", "text-embed-1", "BGE-m3", "text-embed-1"]) == ["text-embed-1", "BGE-m3"]


def test_ranks_of_one_large_group(spark):
    """Running sums over ranges equal those of one window, with a group of nearly all rows, null groups and ties."""
    r = random.Random(4)
    rows = [(None if r.random() < 0.01 else "big" if r.random() < 0.95 else f"g{r.randrange(3)}", r.randrange(50), r.randrange(3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, n int").groupBy("g", "x").agg(F.sum("n").alias("n"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(((x.g, x.x, x._place) for x in evaluate.placed(df, ["g"], ["x"], "n").collect()), key=str)
        parts = df.repartitionByRange("g", "x").select(F.spark_partition_id().alias("p"), "g").where("g = 'big'").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    want, run = [], {}
    for x in sorted(df.collect(), key=lambda x: x.x):
        run[x.g] = run.get(x.g, 0) + x.n
        want.append((x.g, x.x, run[x.g]))
    assert got == sorted(want, key=str) and parts > 1
    batches = collection.upload_batches(df.select("g", "x"), "g", "x", 7).collect()
    for g in {b.g for b in batches}:
        mine = sorted((b.x, b.batch) for b in batches if b.g == g)
        assert [b for _, b in mine] == [i // 7 for i in range(len(mine))]
