"""Toxicity on held-out rows; language-model scores against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import DOCS
from pyspark.sql import functions as F
from quarry.llm import lm, queries, toxicity
from quarry.llm.common import fold

LABELS = "doc_id long, quality int, toxic int"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check_lm(df, **options):
    rows = df.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1
    counts = Counter(t for r in rows if not held(r) for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = lm.held_out_scores(df, **options).collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id, held(r), len(t := tokens(r.text)), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for r in rows)
    for g, w in zip(sorted(got, key=lambda r: (r.doc_id, r.n_tokens, r.base_score)), want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(g.score) and g.score <= 0
    return got


def test_lm_on_tables(spark, sf, odd_docs, no_docs, clashing):
    got = check_lm(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sum(g.score for g in got if g.held_out) > 1.02 * sum(g.base_score for g in got if g.held_out)
    check_lm(odd_docs, frequent=2)  # nearly every word takes the join
    check_lm(clashing)
    assert lm.held_out_scores(no_docs).collect() == []


def test_lm_without_training(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    check_lm(spark.createDataFrame([(i, "a b", "en", "s", 3) for i in ids], DOCS))


def test_copies_of_training_texts_score_better(spark):
    r = np.random.default_rng(0)
    text = " ".join(f"w{x}" for x in r.integers(0, 200, 300))
    mixed = text.split()
    r.shuffle(mixed)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, text, "en", "s", 1) for i in range(200) if i not in ids] + [(ids[0], text, "en", "s", 1), (ids[1], " ".join(mixed), "en", "s", 1)]
    got = {g.doc_id: g for g in check_lm(spark.createDataFrame(rows, DOCS))}
    assert got[ids[0]].score > 0.5 * got[ids[1]].score
    assert got[ids[1]].score > got[ids[1]].base_score - 5


def whole_filter(grams, q, bits):
    segment = lm.segment_of(grams, bits)
    return lm.Filter(np.concatenate([np.frombuffer(lm.segment_bits(grams[segment == k], q[segment == k]), np.uint8) for k in range(1 << (bits - lm.SEGMENT))]), bits)


def test_filter_reads_counts_back():
    r = np.random.default_rng(1)
    grams = r.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
    count = r.integers(1, 5000, len(grams))
    q = lm.level(count)
    bits = lm.bits_for(lm.bits_set(q))
    f = whole_filter(grams, q, bits)
    assert (f.levels(grams) >= q).all() and (f.levels(grams) == q).mean() > 0.9
    other = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert (f.levels(other) > 0).mean() < 0.02
    assert np.unpackbits(f.data).mean() <= 0.5


@pytest.mark.parametrize("n", [1_000, 3_000_000])
def test_no_level_is_left_out_at_any_size(n):
    """The filter grows: every n-gram is read at its level or higher, nearly all at their own."""
    grams = lm.mix(np.arange(n, dtype=np.uint64))
    q = 1 + (np.arange(n) % 50 == 0) * (np.arange(n) % 9)
    f = whole_filter(grams, q, bits := lm.bits_for(lm.bits_set(q)))
    assert (bits > lm.LEAST) == (n > 100_000) and np.unpackbits(f.data).mean() <= 0.5
    got = f.levels(grams)
    assert (got >= q).all() and (got == q).mean() > 0.87  # three probes in a half full filter hit by chance one time in eight
    assert (f.levels(lm.mix(np.arange(n, n + 50_000, dtype=np.uint64))) > 0).mean() < 0.02


def mixture(text, counts, pairs, total):
    """The model's score by plain counting: quantised counts of words and pairs, one model for each weight."""
    q = lambda c: lm.TYPICAL[lm.level(np.array([c]))[0]] if c else 0.0
    logs = np.zeros(len(lm.WEIGHTS))
    before = None
    for t in tokens(text):
        one, first = q(counts[t]), q(counts[before])
        alone, pair = (one + 0.5) / total, q(pairs[before, t])
        given = min(pair, one, first) / max(first, 1)
        logs += np.log10([(1 - w) * alone + w * given for w in lm.WEIGHTS])
        before = t
    return np.log10(np.mean(10.0 ** (logs - logs.max()))) + logs.max()


def check_scores(df, rel=1e-6, **options):
    """Scores against ``mixture``: nearly all within ``rel``; a false hit of the filter moves a score by a little."""
    rows = df.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1
    learned = [tokens(r.text) for r in rows if not held(r)]
    counts, pairs = Counter(t for x in learned for t in x), Counter(p for x in learned for p in zip([None, *x], x, strict=False))
    total = sum(counts.values()) + 0.5 * (len(counts) + 1)
    got = sorted(lm.held_out_scores(df, **options).select("doc_id", "n_tokens", "base_score", "score").collect())
    want = sorted((r.doc_id, mixture(r.text, counts, pairs, total)) for r in rows)
    near = [g.score == pytest.approx(w[1], rel=rel, abs=1e-6) for g, w in zip(got, want, strict=True)]
    assert sum(near) >= 0.95 * len(near)
    assert [g.doc_id for g in got] == [w[0] for w in want]
    return got


def test_scores_equal_plain_counting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = check_scores(docs)
    assert check_scores(docs, most_bits=0) == some  # too large a filter to broadcast: the same scores
    # the same texts eight times over under other words: each copy scores like the others
    more = docs.select("doc_id", "text", F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("k"))
    more = more.select((F.col("doc_id") + F.col("k") * 10_000_000).alias("doc_id"), F.regexp_replace("text", r"([^\x20\x09-\x0D]+)", F.concat(F.lit("$1_"), F.col("k").cast("string"))).alias("text"))
    check_scores(more, rel=0.01)  # a fuller filter


def test_odd_rows_by_segment(spark, odd_docs, no_docs, clashing):
    for df in (odd_docs, clashing):
        check_lm(df, most_bits=0, frequent=2)
    assert lm.held_out_scores(no_docs, most_bits=0).collect() == []


@pytest.mark.parametrize("bits", [24, 31, 34])
def test_a_slice_asks_few_groups(spark, sf, bits):
    """A row for each segment would be 16,384 rows a slice at 34 bits: slices times segments, both of which grow with the corpus."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made = spark.createDataFrame([(k, texts[k::3]) for k in range(3)], "slice long, texts array<string>")
    got = sorted(lm.questions(made, bits).collect(), key=lambda r: (r.slice, r.group))
    groups = 1 << min(bits - lm.SEGMENT, lm.GROUP)
    assert len(got) <= 3 * groups <= 3 * 1024
    for k in range(3):
        asked = np.concatenate([np.frombuffer(r.bytes, np.uint64) for r in got if r.slice == k])
        assert (asked == lm.Slice(pa.array(texts[k::3])).grams).all()
    assert all((np.frombuffer(r.bytes, np.uint64) >> np.uint64(64 - groups.bit_length() + 1) == r.group).all() for r in got)


def test_groups_of_several_segments(spark, sf, monkeypatch):
    """A filter of 2,048 segments in 1,024 groups; nearly empty, so it has next to no false hit."""
    monkeypatch.setattr(lm, "LEAST", 31)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_scores(docs, most_bits=0) == check_scores(docs, most_bits=31)


def test_counts_of_many_small_slices(spark, sf, odd_docs):
    """Blocks of one part come from many slices and tasks, and several parts lie in one batch."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
        check_scores(docs, most_bits=0)
        check_lm(docs, most_bits=0, frequent=2)
        check_lm(odd_docs.repartition(3), most_bits=0, frequent=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_toxicity_held_out(spark, sf):
    large = sf.replace("sf0.001", "sf0.1")
    got = queries.op1_toxicity(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    hit = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert sum(hit) >= 0.7 * len(hit) and sum(clean) <= 0.01 * len(clean)  # about 3,000 rows to learn from
    low = np.array([r.score for r in out if r.toxic == 0])
    assert np.mean([(low < r.score).mean() for r in out if r.toxic == 1]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def plain_ftrl(rows, labels, order, alpha=1.0, beta=1.0, l1=6.0, l2=0.1):
    """FTRL-proximal coordinate by coordinate, with dictionaries."""
    n, z, bias = Counter(), Counter(), [0.0, 0.0]
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for i in order:
        b = -bias[1] / ((beta + math.sqrt(bias[0])) / alpha)
        w = {j: weight(j) for j in rows[i]}
        p = 1 / (1 + math.exp(-(sum(w.values()) + b)))
        g = p - labels[i]
        for j, wj in w.items():
            z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * wj
            n[j] += g * g
        bias[1] += g - (math.sqrt(bias[0] + g * g) - math.sqrt(bias[0])) / alpha * b
        bias[0] += g * g
    return {i: weight(i) for i in z if weight(i)}, b


def test_ftrl_steps():
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 60, 8)).astype(np.int32) for _ in range(300)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    model = toxicity.ftrl(rows, labels, 6, l1=0.5, epochs=3, seed=11)
    order = np.random.default_rng(11)
    want, bias = plain_ftrl([x.tolist() for x in rows], labels, [i for _ in range(3) for i in order.permutation(300)], l1=0.5)
    got = dict(zip(model.place.tolist(), model.weight.tolist(), strict=True))
    assert got.keys() == want.keys() and 0 < len(got) < 60
    assert all(got[i] == pytest.approx(want[i], rel=1e-5) for i in want) and model.bias == pytest.approx(bias, rel=1e-9)
    assert sorted(got, key=got.get)[-2:] in ([3, 7], [7, 3])


def test_toxicity_bound_takes_the_same_rows_however_dealt(spark, sf):
    """Where ``most_features`` cuts the sample, the model doesn't depend on the order in which rows arrive."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    models = [toxicity.fit(docs.repartition(k).sortWithinPartitions(order), labels, most_features=6000) for k, order in ((1, "doc_id"), (5, F.desc("doc_id")))]
    assert models[0].bias == models[1].bias and (models[0].place == models[1].place).all() and (models[0].weight == models[1].weight).all()


def test_toxicity_edges(spark, odd_docs, no_docs, clashing):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(17)] + [(None, 1, 1), (3, 1, None), (5, 1, 1), (5, 1, 0)], LABELS)
    for df in (odd_docs, clashing):
        out = toxicity.score(df, toxicity.fit(df, labels))
        assert out.columns == [*(c for c in df.columns if c != "score"), "score"]
        assert all(0 <= r.score <= 1 for r in out.collect())
    none = toxicity.fit(odd_docs, spark.createDataFrame([], LABELS))
    assert all(r.score < 0.01 for r in toxicity.score(odd_docs, none).collect())
    assert toxicity.score(no_docs, none).collect() == []
    ones = toxicity.fit(odd_docs, labels.where("toxic = 1"))
    assert all(r.score > 0.99 for r in toxicity.score(odd_docs, ones).collect())


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", fold("doc_id", 4, 2).alias("f")).collect()
    assert all(r.f == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
