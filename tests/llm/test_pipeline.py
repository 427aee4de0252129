"""The pipeline's stages on the small tables against brute force."""

from collections import defaultdict

import corpus_pipeline as cp
import pytest
from conftest_rows import DOCS, MEDIUM as SF
from quarry.llm import queries
from test_neighbours import plain_repeats
from test_similar import shingles


def similar_pairs(texts):
    """Jaccard similarity of every pair of texts that share a five-word shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    by, shared = defaultdict(list), defaultdict(int)
    for d, x in sets.items():
        for g in x:
            by[g].append(d)
    for ds in by.values():
        for a in ds:
            for b in ds:
                if a < b:
                    shared[a, b] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == list(cp.COLUMNS)
        seen[name] = (before, docs.collect())
    before, after = seen["quality rules"]
    left = {r.doc_id for r in after}
    known = {r.doc_id: r.kept for r in queries.op7_quality(spark, SF).collect()}
    assert left == {d for d, kept in known.items() if kept}
    before, after = seen["toxicity"]
    left = {r.doc_id for r in after}
    toxic = [d for d in before if d in labels and labels[d].toxic]
    clean = [d for d in before if d in labels and not labels[d].toxic]
    assert sum(d not in left for d in toxic) >= 0.8 * len(toxic) and sum(d in left for d in clean) >= 0.99 * len(clean)
    before, after = seen["simhash near-dedup"]
    near = similar_pairs({d: r.text for d, r in before.items()})
    left = {r.doc_id for r in after}
    close = [p for p, x in near.items() if x >= 0.85]
    assert len(close) > 20 and sum(len(left & set(p)) < 2 for p in close) >= 0.95 * len(close)
    assert all(any(d in p and x >= 0.6 for p, x in near.items()) for d in set(before) - left)
    assert all(r == before[r.doc_id] for r in after)
    before, after = seen["substring dedup"]
    removed = {d: n for d, _, n, _ in plain_repeats([(d, r.text) for d, r in before.items()])}
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        was = before[r.doc_id]
        assert len(r.text.split()) == len(was.text.split()) - removed[r.doc_id] and r.n_chars == len(r.text)
        assert removed[r.doc_id] or r.text == was.text
    before, after = seen["packing"]
    total = defaultdict(int)
    for p in after:
        total[p.doc_id] += p.length
    assert set(total) == set(before) and all(total[p.doc_id] == p.doc_tokens for p in after)
    again = cp.run(spark, SF).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in again} == dict(total)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, k):
    name, stage = cp.STAGES[k]
    stage(spark, odd_docs, SF).collect()
    assert stage(spark, no_docs, SF).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "a b c", None, None, None)] * 2, DOCS)
    out = stage(spark, nulls, SF).collect()
    assert len(out) == {0: 0}.get(k, len(out))
