"""Packing by the configuration program: exact round trips, whole counts, and distance from the bound."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.llm import config_lp, tokens
from quarry.llm.queries import BYTE_BPE, op11_best_fit_packing

BYTE = tokens.public_path(BYTE_BPE)


def best_fit_decreasing(counts, capacity):
    free, n = Counter(), 0
    for size in range(capacity, 0, -1):
        for _ in range(int(counts[size])):
            fit = min((f for f in free if f >= size and free[f]), default=None)
            if fit is None:
                n, fit = n + 1, capacity
            else:
                free[fit] -= 1
            free[fit - size] += 1
    return n


def exact(configs, counts, capacity):
    held = np.zeros(capacity + 1, dtype=int)
    for times, config in configs:
        assert times > 0 and sum(n * k for n, k in config) <= capacity
        for n, k in config:
            held[n] += times * k
    assert (held == counts).all()
    return sum(times for times, _ in configs)


def test_knapsack_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        price = np.concatenate([[0], r.random(12) * (r.random(12) < 0.6)])
        best, used = config_lp.knapsack(price, 12)
        want = [0.0]
        for c in range(1, 13):
            want.append(max([want[c - 1], *(price[n] + want[c - n] for n in range(1, c + 1))]))
        assert np.allclose(best, want)
        for c in range(13):
            found = config_lp._read(used, c)
            assert sum(n * k for n, k in found.items()) <= c and abs(sum(price[n] * k for n, k in found.items()) - best[c]) < 1e-9


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plans_hold_exactly_what_there_is(lengths):
    counts = np.bincount(lengths, minlength=25)
    configs, bound = config_lp.plan(counts, 24)
    n = exact(configs, counts, 24)
    assert bound - 1e-6 <= n <= best_fit_decreasing(counts, 24)


@pytest.mark.parametrize("low,high,n,most", [(300, 401, 20_000, 1.06), (200, 601, 20_000, 1.01), (1, 1025, 20_000, 1.02), (340, 343, 9000, 1.01), (513, 1025, 3000, 1.03), (10, 200, 5000, 1.002)])
def test_close_to_the_bound(low, high, n, most):
    counts = np.bincount(np.random.default_rng(2).integers(low, high, n), minlength=1025)
    configs, bound = config_lp.plan(counts, 1024)
    found = exact(configs, counts, 1024)
    assert found <= np.ceil(bound) * most + 1 and found <= best_fit_decreasing(counts, 1024) * 1.001


def test_bound_is_the_optimum_where_it_is_known():
    counts = np.zeros(1025, dtype=int)
    counts[600], counts[424], counts[341], counts[342] = 100, 100, 150, 50
    configs, bound = config_lp.plan(counts, 1024)
    assert exact(configs, counts, 1024) in (167, 168) and 160 < bound <= 168


def check(pieces, ids, capacity=1024):
    """Every id once and in order, no gaps, no needless cut."""
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_row) == set(ids)
    for name, ps in by_row.items():
        ps.sort(key=lambda p: p.piece)
        want, at = ids[name], 0
        assert [p.piece for p in ps] == list(range(len(ps))) and len(ps) == -(-len(want) // capacity)
        assert all(p.length == capacity for p in ps[1:])
        for p in ps:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def ids_of(text):
    return [*tokens.library(BYTE).encode(text or "", add_special_tokens=False).ids, 2]


def test_given_documents(spark, sf):
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check(op11_best_fit_packing(spark, sf).collect(), docs)
    assert n <= -(-sum(map(len, docs.values())) // 1024) * 1.02 + 1


@pytest.mark.parametrize("which", ["odd", "clash"])
def test_odd_documents(which, odd_docs, clashing):
    df = {"odd": odd_docs, "clash": clashing}[which]
    docs = {r.doc_id: ids_of(r.text) for r in df.collect()}
    check(config_lp.pack(df, BYTE).collect(), docs)
    rows = config_lp.pack(df.repartition(5), BYTE, capacity=64, with_ids=True).collect()
    check(rows, docs, 64)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in rows)


def test_repeated_null_and_no_rows(spark, odd_docs, no_docs):
    twice = config_lp.pack(odd_docs.union(odd_docs), BYTE).collect()
    assert sum(p.length for p in twice) == 2 * sum(p.length for p in config_lp.pack(odd_docs, BYTE).collect())
    nulls = config_lp.pack(spark.createDataFrame([(None, None), (None, "a"), (None, "a")], "doc_id long, text string"), BYTE).collect()
    assert len(nulls) == 3 and len({p.sequence_id for p in nulls}) == 1 and sorted(p.offset for p in nulls) in ([0, 1, 3], [0, 2, 4], [0, 2, 3])
    assert config_lp.pack(no_docs, BYTE).count() == 0
