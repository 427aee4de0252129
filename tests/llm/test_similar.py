"""Near-duplicates by similarity against exact Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest
from conftest_rows import DOCS, MEDIUM, rows_of
from quarry.llm import simhash_similar as s


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def family(r, n, edits):
    """A text and near copies with some words replaced in one stretch."""
    words = [f"w{r.randint(0, 3000)}" for _ in range(n)]
    out = [" ".join(words)]
    for e in edits:
        copy = list(words)
        at = r.randint(0, n - e)
        copy[at : at + e] = [f"x{r.randint(0, 3000)}" for _ in range(e)]
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("bucket_rows", [8192, 7])
def test_recall_and_clean(spark, bucket_rows):
    r = random.Random(8)
    texts, groups = [], []
    for _ in range(40):
        f = family(r, r.choice([80, 200, 600]), [1, 2, 3])
        groups.append(range(len(texts), len(texts) + len(f)))
        texts += f
    texts += [" ".join(f"w{r.randint(0, 3000)}" for _ in range(150)) for _ in range(150)]
    got = {x.doc_id: x.component_id for x in s.similar(spark.createDataFrame(rows_of(texts), DOCS).repartition(4), bucket_rows=bucket_rows).collect()}
    assert len(got) == len(texts)
    pairs = [(g[0], i) for g in groups for i in g[1:] if len(shingles(texts[g[0]]) & shingles(texts[i])) >= 0.85 * len(shingles(texts[g[0]]) | shingles(texts[i]))]
    assert len(pairs) > 80 and sum(got[a] == got[b] for a, b in pairs) >= 0.93 * len(pairs)
    assert all(got[i] == i for i in range(160, len(texts)))


def test_hot_group(spark):
    r = random.Random(9)
    texts = family(r, 400, [1] * 120) + ["one two three four five six"] * 50 + [None, "", " "]
    got = {x.doc_id: x.component_id for x in s.similar(spark.createDataFrame(rows_of(texts), DOCS), bucket_rows=16).collect()}
    assert sum(got[i] == 0 for i in range(121)) >= 118
    assert {got[i] for i in range(121, 171)} == {121} and {got[i] for i in (171, 172, 173)} == {171}
    kept = s.keep_first(spark.createDataFrame(rows_of(texts), DOCS)).collect()
    assert {x.doc_id for x in kept} == {i for i, c in got.items() if i == c}


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    for df in (odd_docs, clashing):
        got = {x.doc_id: x.component_id for x in s.similar(df).collect()}
        assert got[11] == got[10] == 10 and got[0] == got[1] == got[2] == 0 and got[12] == 12
    assert s.similar(no_docs).collect() == []
    nulls = spark.createDataFrame([(None, "a b c", None, None, None)] * 2 + [(4, "a b c", None, None, None)], DOCS)
    assert len(s.keep_first(nulls).collect()) == 3


def test_votes_of_long_texts():
    text = b"a b c d e f g " * 20_000
    assert np.array_equal(np.sign(s.votes(text, 5, 42)), np.sign(s.votes(b"a b c d e f g " * 20_000, 5, 42)))


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 4, "group_rows": 4}])
def test_links_on_both_sides_of_the_threshold(spark, options):
    """Pairs just at 0.8 are linked, pairs just under it aren't."""
    r = random.Random(12)
    texts, want = [], []
    for k in range(240):
        n = r.choice([5, 9, 20, 50, 100, 400])
        words = [f"p{k}x{i}" for i in range(n + 4)]
        copy = list(words)
        limit = n // 9  # n shingles of which m are replaced: (n - m) / (n + m) >= 0.8
        m = limit if k % 2 else limit + 1
        for i in range(m):  # at the end, each word takes one shingle more
            copy[-1 - i] = f"q{k}x{i}"
        texts += [" ".join(words), " ".join(copy)]
        a, b = shingles(texts[-2]), shingles(texts[-1])
        want.append(5 * len(a & b) >= 4 * len(a | b))
    assert sum(want) == 120 and [bool(k % 2) for k in range(240)] == want
    got = {x.doc_id: x.component_id for x in s.similar(spark.createDataFrame(rows_of(texts), DOCS), **options).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(240)] == want


def test_links_are_those_of_all_pairs(spark):
    """The components on a table are those of exact similarity over all pairs."""
    from test_pipeline import similar_pairs

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), x in similar_pairs(texts).items():
        if x >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {x.doc_id: x.component_id for x in s.similar(docs).collect()} == {d: find(d) for d in texts}


def test_repeated_ids_keep_one_row(spark):
    """A repeated row leaves one copy; a row of the same id with a text of its own stays."""
    from quarry.llm import simhash

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, c)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    for module in (s, simhash):
        kept = module.keep_first(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, c), (0, c), (1, a), (2, b), (3, c)]
