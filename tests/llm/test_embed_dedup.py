"""Vector links against brute force."""

import numpy as np
import pytest
from quarry.llm import embed_dedup


def plain(rows, cosine=0.98):
    sound = [(i, lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links, label = {k: 0 for k in range(len(sound))}, list(range(len(sound)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for p in range(len(sound)):
        for q in range(p):
            a, b = sound[p], sound[q]
            if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= cosine:
                links[p] += 1
                links[q] += 1
                label[root(p)] = root(q)
    least = {}
    for k, s in enumerate(sound):
        least[root(k)] = min(s[0], least.get(root(k), s[0]))
    return sorted((sound[k][0], links[k], least[root(k)]) for k in range(len(sound)))


def planted(n=300, width=64, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n // 10):
        centre = r.normal(size=width)
        for _ in range(10):
            rows.append((len(rows), (centre + r.normal(size=width) * r.choice([0.0, 0.05, 0.1, 0.14])).tolist(), int(c % 3)))
    return rows


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_planted(spark, bucket_rows):
    rows = planted()
    want = plain(rows)
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    total = sum(w[1] for w in want)
    assert 0.97 * total <= sum(r.n_links for r in got) <= total
    by = {w[0]: w for w in want}
    assert all(r.n_links <= by[r.vec_id][1] for r in got)
    assert sum((r.n_links, r.component_id) == by[r.vec_id][1:] for r in got) >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_hot_group_and_odd_rows(spark):
    base = planted(100, 8)
    r = np.random.default_rng(2)
    hot = r.normal(size=8)
    rows = base + [(1000 + i, hot.tolist(), 1) for i in range(200)]
    rows += [(2000 + i, (hot + r.normal(size=8) * 0.01).tolist(), 1) for i in range(150)]
    odd = [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 8, 1), (3003, [float("nan")] * 8, 1), (3004, [float("inf")] + [0.0] * 7, 1), (3005, [None] + [1.0] * 7, 1), (3006, hot.tolist(), None), (3007, [1.0], 1), (3008, [2.0], 1), (3009, [-2.0], 1), (3010, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(5)
    df = df.selectExpr("*", "'x' as node", "'y' as n_links", "'z' as component_id")
    want = {w[0]: w[1:] for w in plain(rows + odd)}
    got = {x.vec_id: x for x in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(3000, 3007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[3007].n_links == got[3008].n_links == 1 and got[3009].n_links == 0
    assert sum((got[i].n_links, got[i].component_id) == w for i, w in want.items()) >= 0.97 * len(want)
    assert all(got[i].n_links <= w[0] for i, w in want.items())


def test_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_recall_on_larger_table(spark):
    """Clusters whose pairs lie on both sides of 0.98, with exact copies among them."""
    rows = planted(4000, 64, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([lab for _, _, lab in rows])
    n = ((x @ x.T >= 0.98) & (label[:, None] == label[None])).sum(axis=1) - 1
    here = np.array([got[i] for i, _, _ in rows])
    assert len(got) == len(rows) and (here <= n).all()
    assert n.sum() > 1000 and here.sum() >= 0.97 * n.sum()


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.7]), ("string", ["left", "right"]), ("boolean", [True, False])])
def test_labels_of_other_types_are_compared_as_they_are(spark, kind, labels):
    v = [0.5, 1.0, -2.0, 0.25]
    rows = [(0, v, labels[0]), (1, v, labels[1]), (2, v, labels[0]), (3, v, None), (4, v, labels[1])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 0, 3), (4, 1, 1)]
