"""SimHash components and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest_rows import DOCS, rows_of
from quarry.llm import simhash, substring


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    label = {d: d for d in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    items = sorted(fps)
    arr = np.array([fps[d] for d in items], np.uint64)
    for i, d in enumerate(items):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 4):
            a, b = root(d), root(items[j])
            label[max(a, b)] = min(a, b)
    return {d: root(d) for d in fps}


def check_simhash(df):
    rows = df.collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(fps)
    got = simhash.near_duplicates(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_golay_tables():
    g = simhash.Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    near = g.nearby(words)
    assert near.shape[1] == 6
    for flips in (1, 2):
        other = words.copy()
        for k in range(flips):
            other ^= 1 << ((words % 11) + 11 * k)
        assert all(set(a) & set(b) for a, b in zip(near.tolist(), g.nearby(other).tolist(), strict=True))


def test_keys_meet_at_four_bits():
    r = random.Random(4)
    g = simhash.Golay()
    a = np.array([r.getrandbits(64) for _ in range(4000)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.sample(range(64), r.randint(0, 4)):
            b[i] ^= np.uint64(1 << bit)
    keys = []
    for x in (a, b):
        row, key = simhash.keys_of(x, g)
        sets = defaultdict(set)
        for i, k in zip(row.tolist(), key.tolist(), strict=True):
            sets[i].add(k)
        keys.append(sets)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


@pytest.mark.parametrize("rows", [40, 8192])
def test_links_in_hot_buckets(spark, rows):
    """A ball of fingerprints around one: buckets over ``rows`` are compared in blocks."""
    r = random.Random(6)
    fps = {0}
    while len(fps) < 300:
        fps.add(sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    out = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_rows=rows).collect()
    label = {x: x for x in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in out:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        label[root(a)] = root(b)
    assert len({root(x) for x in signed}) == 1
    assert len(out) < 300 * 60


def test_simhash_on_tables(spark, sf, odd_docs, no_docs, clashing):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, clashing):
        check_simhash(df)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_keep_first(spark):
    df = spark.createDataFrame(rows_of(["a b c d e f", "a b c d e f", "other words stand here now", None, ""]), DOCS)
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [0, 2, 3]


def plain_repeats(rows, length=13):
    first = {}
    for d, t in rows:
        if d is not None:
            w = (t or "").encode().split()
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_repeats(df):
    got = [tuple(r) for r in substring.remove_repeats(df, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == plain_repeats([(r.doc_id, r.text) for r in df.collect()])


def test_repeats_on_tables(spark, sf, odd_docs, no_docs, clashing):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/documents.parquet").repartition(7), odd_docs, clashing):
        check_repeats(df)
    assert substring.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("words", [2, 4, 300])
def test_repeats_planted(spark, words):
    """Small vocabularies make runs of equal hashes; passages of 12 to 30 words repeat, some within one document."""
    r = random.Random(words)
    vocab = [f"w{i}" for i in range(words)]
    passages = [[r.choice(vocab) for _ in range(n)] for n in (12, 13, 14, 30)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(vocab) for _ in range(r.randint(0, 25))] + r.choice(passages)
        rows.append((r.choice([d, d, d, None, d - 1]), " ".join(w)))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_cut_repeats_keeps_clashing_columns(spark, clashing, odd_docs, no_docs):
    plain = {r.doc_id: (r.text, r.n_removed) for r in substring.cut_repeats(odd_docs).collect()}
    out = substring.cut_repeats(clashing)
    assert out.columns == [*(c for c in clashing.columns if c != "n_removed"), "n_removed"]
    rows = out.collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == plain
    assert all(r._doc == r._at == r.doc == r.row == "clash" for r in rows)
    assert substring.cut_repeats(no_docs).collect() == []


def test_frequent_anchors_change_no_result(spark, monkeypatch):
    """A stock phrase in ever new surroundings, with longer passages around it in some documents: met by extension it gives the same."""
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    phrase, passage = "all of these rights are reserved", words(20)
    texts = []
    for i in range(120):
        around = words(20) if i % 4 else passage
        texts.append(f"{words(30)} {around} {phrase} {passage if i % 3 == 0 else words(9)} {words(15)}")
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(5)
    want = sorted(substring.remove_repeats(df).collect())
    assert sum(x.n_removed for x in want) > 500
    seen = []
    one = substring.frequent_anchors
    monkeypatch.setattr(substring, "frequent_anchors", lambda *a: seen.append(one(*a)) or seen[-1])
    monkeypatch.setattr(substring, "FREQUENT", 2)
    assert sorted(substring.remove_repeats(df).collect()) == want and len(seen[0]) > 0
    monkeypatch.setattr(substring, "FREQUENT", 1)  # all of them
    assert sorted(substring.remove_repeats(df).collect()) == want


def test_repeats_of_one_id_with_very_many_texts(spark):
    """2,000 texts under one id, of which only some repeat a passage of a smaller id."""
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = words(40)
    rows = [(1, " ".join(words(5) + passage))]
    rows += [(2, " ".join(words(r.randint(0, 60)) + (passage[r.randint(0, 20) :] if i % 3 == 0 else words(100)) + words(2))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_repeats(df)
    got = sorted((r.doc_id, r.n_removed) for r in substring.cut_repeats(df).collect())
    assert got == sorted((d, n) for d, _, n, _ in plain_repeats(rows))
