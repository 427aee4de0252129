"""Statistics against plain Python; learned lists on rows with a known rule and on the labelled documents."""

import random

import pytest
from conftest_rows import DOCS, rows_of
from quarry.llm import quality

SPACES = b" \t\n\x0b\x0c\r"


def plain(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().strip(SPACES)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
    if hit is None:
        from collections import Counter

        hit = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + j for i, g in enumerate(grams) if g in hit for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ["a b c a b c", "x x x x x", "x x x x", "x x x", "l1\nl1\n \nl2\nl1", "a\x0bb\x0cc\rd", "one two three four one two three", "|<>#*$%&!", "é é é é\n\né é é é"]


def test_statistics(spark, sf, odd_docs, no_docs, clashing):
    more = spark.createDataFrame(rows_of(EXTRA), DOCS)
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, more, clashing):
        for r in quality.statistics(df.select("doc_id", "text")).collect():
            assert tuple(r[c] for c in COLS) == plain(r.text), r.text[:80]
    assert quality.statistics(no_docs).collect() == []


def test_learn_finds_the_rule():
    r = random.Random(3)
    rows = []
    for i in range(900):
        row = {f: r.random() for f in quality.FEATURES}
        row["bad"] = int(row["upper_ratio"] > 0.7 and row["n_words"] < 0.5 or row["symbol_ratio"] > 0.9)
        rows.append(row)
    rules = quality.learn(rows, bins=40)
    hit = lambda row: any(all((row[c.feature] >= c.threshold) == c.above or row[c.feature] == c.threshold for c in rule) for rule in rules)
    wrong = sum(hit(row) != bool(row["bad"]) for row in rows)
    assert wrong < 40, [list(map(str, x)) for x in rules]


def test_learn_without_both_kinds():
    row = dict.fromkeys(quality.FEATURES, 0.5)
    assert quality.learn([]) == [] and quality.learn([row | {"bad": 0}] * 9) == [] and quality.learn([row | {"bad": 1}] * 9) == []


@pytest.fixture(scope="module")
def tables(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_labelled_documents(tables):
    docs, labels = tables
    rules = quality.learned(docs, labels)
    out = quality.judge(docs.select("doc_id", "text"), rules).join(labels, "doc_id").collect()
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    bad = [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    plan = quality.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_no_labels(spark, odd_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality.learned(odd_docs, empty)
    assert rules == []
    assert all(r.kept == (not r.base_failed) for r in quality.judge(odd_docs.select("doc_id", "text"), rules).collect())


def test_keep_leaves_columns_alone(clashing, odd_docs):
    kept = quality.keep(clashing, [])
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert all(r.rule == r.kept == r.n_words == r._row == r._words == "clash" for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in quality.judge(odd_docs, []).collect() if r.kept)
