"""SimHash near-duplicates by similarity: prefix keys, wide fingerprints as a filter, exact similarity.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is at least 4/5. Any such pair shares a shingle of both sets' prefixes:
the first n - ceil(4n/5) + 1 of a set's n shingles in one order for all documents.
The order is by hash, with shingles that are frequent in a sample of the documents
last (the sample changes only the size of buckets, no result). Rows that meet by a
prefix shingle and whose 256-bit fingerprints differ in at most ``radius`` bits are
candidates: at similarity 4/5 they differ in 39 bits on average, unrelated ones in
128. Groups of candidates then get their texts, and every link is verified by the
sets themselves; groups over ``group_rows`` or ``GROUP_BYTES`` are dealt into blocks,
compared pair by pair in groups of their own.

Equal sets are one row. Buckets tie what candidates join to its least row; those over
``bucket_rows`` are dealt into blocks as well. Null text counts as empty; texts
without words are alike. Rows without an id stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix, slices, utf8, written
from .components import components

WORDS64 = 4
#: Documents looked at for frequent shingles, the least count there, and the most that are kept.
SAMPLED, FREQUENT, MOST = 20_000, 4, 1 << 17
#: Text bytes of a group that are compared in one task.
GROUP_BYTES = 16_000_000


def shingles(text: bytes, width: int, seed: int) -> np.ndarray:
    """The set of a text's shingles: hashes in order, without repeats."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64))


def set_votes(h: np.ndarray) -> np.ndarray:
    """For each of 256 bits, how many shingles have it set over those that don't."""
    n = len(h)
    if not n:
        return np.full(64 * WORDS64, -1, np.int64)
    out = []
    for k in range(WORDS64):
        total = np.zeros(64, np.int64)
        m = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype("<u8")
        for at in range(0, n, 65_536):
            total += np.unpackbits(m[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(2 * total - n)
    return np.concatenate(out)


def votes(text: bytes, width: int, seed: int) -> np.ndarray:
    return set_votes(shingles(text, width, seed))


def prefix(h: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a set of similarity 4/5 or more shares one; ``frequent`` (sorted) come last, by ``rank``."""
    most = len(h) - (4 * len(h) + 4) // 5 + 1 if len(h) else 0
    if not len(frequent):
        return h[:most]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    last = frequent[at] == h
    return np.concatenate([h[~last], h[last][np.argsort(rank[at[last]])]])[:most]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 4/5."""
    if len(x) > len(y):
        x, y = y, x
    if 5 * len(x) < 4 * len(y):
        return False
    if not len(x):
        return True
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 5 * both >= 4 * (len(x) + len(y) - both)


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= radius


def forest(x: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows of ``x``; with ``split`` only of those between x[:split] and x[split:]."""
    label = np.arange(len(x))
    out = []
    for i in range(split or 1, len(x)):
        rest, size = np.arange(split or i), 32
        while len(rest := rest[label[rest] != label[i]]):  # a component is left as soon as one of its rows is linked
            part, rest, size = rest[:size], rest[size:], min(4 * size, 4096)
            hit = part[near(x[part], x[i], radius)]
            if len(hit):
                for j in hit[np.unique(label[hit], return_index=True)[1]]:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return out


def exact_forest(sets: list[np.ndarray], x: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` that are alike; fingerprints ``x`` and sizes tell which are compared."""
    n = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    out = []
    for i in range(split or 1, len(sets)):
        rest = np.arange(split or i)
        rest = rest[(label[rest] != label[i]) & (5 * np.minimum(n[rest], n[i]) >= 4 * np.maximum(n[rest], n[i]))]
        rest = rest[near(x[rest], x[i], radius)]
        while len(rest):
            j, rest = int(rest[0]), rest[1:]
            if alike(sets[i], sets[j]):
                out.append((i, j))
                label[label == label[j]] = label[i]
                rest = rest[label[rest] != label[i]]
    return out


def stars(pairs: list[tuple[int, int]] | np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows joined by ``pairs`` with the first row of their group: groups of one bucket that meet again in others give few new edges."""
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def links(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """rows (key, node, fp) -> (a, b): each node with the least node that links lead to within a bucket."""
    size = 8 * WORDS64

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("fp", pa.binary())])

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)

        def bucket(node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            member, first = stars(forest(x, radius), len(node))
            return edges(node[member], node[first])

        def block_of(key: int, number: int, node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            n = len(node)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), pa.array(np.full(n, key)), pa.array(np.full(n, number)), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

        held_key, nodes, held, blocks = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held_key, nodes, held, blocks
            if held_key is not None:
                n, x = np.concatenate(nodes), np.concatenate(held)
                if blocks:
                    yield block_of(held_key, blocks, n, x)
                elif len(n) > 1:
                    yield bucket(n, x)
            held_key, nodes, held, blocks = None, [], [], 0

        for batch in slices(batches, 100_000, 16_000_000):
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WORDS64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            if held_key is not None and key[0] != held_key:
                yield from close()
            small = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if held_key is not None or e == len(key) or e - s > bucket_rows:
                    held_key = int(key[s])
                    for at in range(s, e, bucket_rows):
                        if sum(map(len, nodes)) + min(e - at, bucket_rows) > bucket_rows:
                            yield block_of(held_key, blocks, np.concatenate(nodes), np.concatenate(held))
                            nodes, held, blocks = [], [], blocks + 1
                        nodes.append(node[at : min(e, at + bucket_rows)])
                        held.append(x[at : min(e, at + bucket_rows)])
                    if e < len(key):
                        yield from close()
                elif e - s > 32:
                    yield bucket(node[s:e], x[s:e])
                elif e - s > 1:
                    small.append((s, e))
            if small:
                at = np.concatenate([np.arange(s, e) for s, e in small])
                k, n, y, left, shift, found = key[at], node[at], x[at], np.arange(len(at)), 1, []
                while True:
                    left = left[left + shift < len(at)]
                    left = left[k[left] == k[left + shift]]
                    if not len(left):
                        break
                    hit = left[near(y[left], y[left + shift], radius)]
                    found.append(np.stack([hit, hit + shift], axis=1))
                    shift += 1
                member, first = stars(np.concatenate(found), len(n))
                yield edges(n[member], n[first])
        yield from close()

    def compare(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values(["block", "a"])
        x, i, j = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(-1, size // 8), pdf["i"].iloc[0], pdf["j"].iloc[0]
        member, first = stars(forest(x, radius, None if i == j else int((pdf["block"] == i).sum())), len(pdf))
        node = pdf["a"].to_numpy()
        return pd.DataFrame({"a": node[member], "b": node[first]})

    met = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "a long, b long, key long, block long, fp binary")
    met = written(met, "similar")
    hot = met.where("block is not null").select("a", "key", "block", "fp")
    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = hot.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = pairs.select("a", "fp", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.where("block is null").select("a", "b").union(pairs.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")).distinct()


def ordering(docs: DataFrame, text_col: str, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of distinct texts, sorted, and their ranks by count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = np.concatenate([shingles(t, width, seed) for t in utf8(batch.column(0))])
            h, c = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    texts = docs.select(docs[text_col].cast("string").alias("text"))
    each = -(-texts.count() // SAMPLED)
    if each > 1:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(each)) == 0)
    counts = texts.distinct().mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    found = counts.orderBy(F.desc("c"), "h").limit(MOST).collect()
    h = np.array([r.h for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - 1 - np.arange(len(h)))[order]


def fingerprinted(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """A row for each row of ``docs``: uid (its own key), id, node (its set), fp, prefix, row, text."""
    frequent, rank = ordering(docs, text_col, width, seed)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            n = batch.num_rows
            sets = [shingles(t, width, seed) for t in utf8(batch.column(1))]
            fp = [np.packbits(set_votes(h) > 0, bitorder="little").tobytes() for h in sets]
            node = mix(np.array([mix(h).sum(dtype=np.uint64) for h in sets], np.uint64) + np.array([len(h) for h in sets], np.uint64))
            keys = [prefix(h, *sent.value).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), batch.column(0), pa.array(node.view(np.int64)), pa.array(fp, pa.binary()), pa.array(keys, pa.binary()), batch.column(2)], ["uid", "id", "node", "fp", "prefix", "row"])
            uid += n

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), F.struct("*").alias("row"))
    schema = StructType().add("uid", "long").add("id", "long").add("node", "long").add("fp", "binary").add("prefix", "binary").add("row", docs.schema)
    return written(rows.mapInArrow(marked, schema), "marked").withColumn("text", F.col("row")[text_col].cast("string"))


def verified(rows: DataFrame, loose: DataFrame, radius: int, width: int, seed: int, group_rows: int) -> DataFrame:
    """Links (a, b) of similarity 4/5 or more within the groups of ``loose`` (node, root), a spanning forest of each block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, nodes, sets, fps = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                x = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS64)
                split = None if held[1] == held[2] else parts.count(held[1])
                if split != 0 and split != len(nodes):
                    member, first = stars(exact_forest(sets, x, radius, split), len(nodes))
                    n = np.array(nodes, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(n[member]), pa.array(n[first])], ["a", "b"])
            for kept in (parts, nodes, sets, fps):
                kept.clear()

        for batch in slices(batches):
            group = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for g, part, node, fp, text in zip(group, *(batch.column(k).to_pylist() for k in (3, 4, 5)), utf8(batch.column(6)), strict=True):
                if g != held:
                    yield from close()
                    held = g
                parts.append(part)
                nodes.append(node)
                fps.append(fp)
                sets.append(shingles(text, width, seed))
        yield from close()

    one = rows.groupBy("node").agg(F.min("uid").alias("uid"), F.first(F.octet_length("text")).alias("size"))
    loose = written(loose.join(one, "node").select("root", "node", "uid", F.coalesce("size", F.lit(0)).alias("size")), "loose")
    blocks = loose.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / group_rows), F.ceil(F.sum("size") / GROUP_BYTES)).cast("long").alias("blocks"))
    dealt = loose.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.join(rows.select("uid", "fp", "text"), "uid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "fp", "text")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "node")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, seed: int, bucket_rows: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their uid, id and node, and (node, component_id)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keys = [np.frombuffer(k, np.int64) for k in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(batch.column(0).to_numpy()[row]), batch.column(1).take(pa.array(row))], ["key", "node", "fp"])

    rows = fingerprinted(docs, id_col, text_col, width, seed)
    distinct = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    keyed = distinct.select("node", "fp", "prefix").mapInArrow(spread, "key long, node long, fp binary")
    loose = components(links(keyed, radius, bucket_rows))
    roots = components(verified(rows, loose, radius, width, seed, group_rows))
    least = rows.groupBy("node").agg(F.min("id").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "groups")  # apart, so that a large component's rows can be split in the join
    return rows, rooted.join(group, "root").select("node", "component_id")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 72, seed: int = 42, bucket_rows: int = 8192, group_rows: int = 512,
) -> DataFrame:
    """(id, component_id): least id reachable by links of similarity 4/5 or more, for every row."""
    rows, by_node = grouped(docs, id_col, text_col, width, radius, seed, bucket_rows, group_rows)
    return rows.select("id", "node").join(by_node, "node").select(F.col("id").alias(id_col), "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 72, seed: int = 42, bucket_rows: int = 8192, group_rows: int = 512,
) -> DataFrame:
    """One row, of the least id, of each component, also where ids repeat; rows without an id stay."""
    rows, by_node = grouped(docs, id_col, text_col, width, radius, seed, bucket_rows, group_rows)
    known = rows.where("id is not null").select("id", "node", "uid").join(by_node, "node")
    first = known.groupBy("component_id").agg(F.min(F.struct("id", "uid")).alias("first")).select("first.uid")
    return rows.select("uid", "row").join(first.union(rows.where("id is null").select("uid")), "uid").select("row.*")
