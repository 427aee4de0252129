"""The stored keyword index against tokenizing and matching each text."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import filters, postings, sparse

SCHEMA = "id long, content string, row string, tf string"


def texts():
    r = random.Random(2)
    some = ["und", "der", "que", "la", "parseHTTPRequest", "HTTPServer", "naïve", "ÉCOLE", "ΣΑΣ", "İstanbul", "x", "the", "42", "a1B2", "日本語", "snake_case", "ǅ", "😀", "Straße"]
    out = [" ".join(r.choice(some) + r.choice(["", "", ",", "-"]) for _ in range(r.randint(0, 30))) for _ in range(80)]
    return [*out, None, "", "   ", "the a of", "und " * 3000 + "der"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i // 2 if i < 40 else i, t, "clash", "clash") for i, t in enumerate(texts())]  # ids repeat
    return spark.createDataFrame([*rows, (None, "und der", None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    postings.Index.build(docs, path, buckets=3)
    return postings.Index.open(spark, path)


def test_postings_are_the_tokens(docs, index):
    want = sorted(((r.id, r.w) for r in docs.select("id", T.tokenize(F.coalesce("content", F.lit(""))).alias("w")).collect()), key=str)
    found = {}
    for r in index.table.collect():
        place = found.setdefault((r.id, r.row), {})
        assert r.tf == len(r.positions) and (r.term == "") == (r.term_hash == postings.NO_TERM)
        for p in r.positions:
            assert p not in place
            place[p] = r.term
    got = sorted(((i, [w[p] for p in range(len(w))]) for (i, _), w in found.items()), key=str)
    assert got == want
    assert {r.term_hash for r in index.table.where("term <> ''").select("term_hash").distinct().collect()} == {r[0] for r in index.table.where("term <> ''").select(T.term_hash("term")).distinct().collect()}


@pytest.mark.parametrize("text", ["und", '"und der"', '"und und"', "und AND NOT der", "NOT und", "the", "", "+und -que la", '("und der" OR que) AND NOT "la la"', "parseHTTPRequest", "école OR ΣΑΣ", "NOT the", '"x y z" OR 日本語'])
def test_boolean_equals_the_predicate(docs, index, text):
    want = sorted((r.id for r in docs.where(filters.text_query(text, T.tokenize(F.coalesce("content", F.lit(""))))).collect()), key=str)
    assert sorted((r.id for r in index.boolean(text).collect()), key=str) == want


def test_ranked(docs, index):
    import math

    tokens = [(r.id, r.w) for r in docs.select("id", T.tokenize(F.coalesce("content", F.lit(""))).alias("w")).collect()]
    count = lambda w, p: sum(w[i : i + len(p)] == p for i in range(len(w)))
    phrases, n, avgdl = [["und", "der"], ["que"]], len(tokens), sum(len(w) for _, w in tokens) / len(tokens)
    df = [sum(count(w, p) > 0 for _, w in tokens) for p in phrases]
    want = []
    for i, w in tokens:
        f = [count(w, p) for p in phrases]
        if any(f) and not count(w, ["la"]):
            score = sum(math.log((n - d + 0.5) / (d + 0.5) + 1) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) for x, d in zip(f, df, strict=True))
            want.append((i, round(score, 6)))
    got = [(r.id, r.score) for r in index.ranked('("und der" OR que) -la', None).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    top = index.ranked('("und der" OR que) -la', 5).collect()
    assert [r.score for r in top] == sorted((s for _, s in want), reverse=True)[:5]


def test_bm25_equals_a_fit(spark, docs, index):
    named = docs.where("id is not null").select("id", "content")
    q = spark.createDataFrame([(1, "und der HTTP unknown"), (2, "école")], "query_id int, text string")
    stored_one = index.bm25()
    fitted = sparse.Bm25(docs.select("id", "content"))
    rows = lambda m: sorted((tuple(r) for r in sparse.top_k(sparse.dot(m.postings(), m.query(q)), 100, "query_id", "id").select("query_id", "id", "score").where("id is not null").collect()))
    assert rows(stored_one) == rows(fitted) and len(rows(fitted)) > 10 and named.count() > 80
    fitted.close()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_leave_the_corpus_where_it_is(spark, index):
    """No tokenizer and no exchange of postings; scans name the terms."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(index.boolean('"und der" OR que'))
        assert "Exchange hashpartitioning" not in plan and "regexp" not in plan and "Python" not in plan and "Arrow" not in plan
        assert "In(term_hash" in plan and "SelectedBucketsCount: 3 out of 3" in plan
        q = index.asked(spark.createDataFrame([(1, "und der HTTP")], "query_id int, text string"))
        plan = plan_of(sparse.dot(index.bm25().postings(), q))
        assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "BroadcastHashJoin [term_hash" in plan and "SelectedBucketsCount: 3 out of 3" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
