"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits, each padded to
the 23 bits of the binary Golay code. Around any word the code has one codeword
within 3 bits (it is perfect) and, where that lies 3 away, five more within 4.
Two segments that differ in at most 2 bits share one of these nearby codewords:
the codeword of a word half-way lies within 4 of both. So with at most 4
differing bits in all:

* both first segments have at most 2 errors: a nearby codeword of each is shared
  (key: two codeword indices);
* the first has 3 or more: the other two have 1 in all, so one is equal and the
  other shares a codeword (key: the equal segment and a codeword index);
* the second has 3 or more: the same with the first and the third.

Distinct fingerprints meet by key; each bucket is verified by popcount and gives
only a spanning forest of its links, never all pairs. A bucket over
``bucket_rows`` is cut into blocks that are compared pair by pair in separate
tasks, so no row is dropped and no task holds a whole hot bucket.

Null text counts as empty, and texts without a word have fingerprint zero and
link like any other. Copies share a fingerprint and so a component. A null id is
kept with the component's least id (null where it has none). Very long texts are
counted by parts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, written
from .components import components

#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xAE3


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of lower-cased (A-Z) word shingles: a bit is 1 if set in over half of their XXH64."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) with the fingerprint's bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, width, seed) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], [id_col, "fp"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, f"{id_col} long, fp long")


class Golay:
    """Codewords near 23-bit words."""

    def __init__(self):
        def remainder(v: int) -> int:
            for i in range(22, 10, -1):
                if v >> i & 1:
                    v ^= GENERATOR << (i - 11)
            return v

        of_bit = [remainder(1 << i) for i in range(23)]
        self.by_byte = [np.zeros(256, np.int64) for _ in range(3)]
        for part in range(3):
            for v in range(256):
                for i in range(8):
                    if v >> i & 1 and 8 * part + i < 23:
                        self.by_byte[part][v] ^= of_bit[8 * part + i]
        errors: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = e = 0
                for i in bits:
                    s ^= of_bit[i]
                    e |= 1 << i
                errors[s].append(e)
        most = max(map(len, errors))
        #: For each syndrome the error patterns of at most 4 bits, the first repeated as padding.
        self.errors = np.array([x + x[:1] * (most - len(x)) for x in errors], dtype=np.int64)

    def nearby(self, words: np.ndarray) -> np.ndarray:
        """(n, 6): 12-bit indices of the codewords within 4 bits, padded with the first."""
        syndrome = self.by_byte[0][words & 255] ^ self.by_byte[1][words >> 8 & 255] ^ self.by_byte[2][words >> 16]
        return (words[:, None] ^ self.errors[syndrome]) >> 11


def keys_of(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64), as (row, key), without repeats in a row."""
    parts = [(fp & np.uint64((1 << 22) - 1)).astype(np.int64), (fp >> np.uint64(22) & np.uint64((1 << 21) - 1)).astype(np.int64), (fp >> np.uint64(43)).astype(np.int64)]
    near = [golay.nearby(p) for p in parts]
    n = len(fp)
    found = [(near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(n, -1)]
    for kind, (equal, coded) in enumerate(((1, 2), (2, 1), (0, 2), (2, 0)), start=1):
        found.append(kind << 40 | parts[equal][:, None] << 12 | near[coded])
    keys = np.sort(np.concatenate(found, axis=1), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(first)[0], keys[first]


def forest(x: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``x``; with ``split`` only of those between x[:split] and x[split:]."""
    label = np.arange(len(x))
    out = []
    for i in range(split or 1, len(x)):
        rest, size = np.arange(split or i), 32
        while len(rest := rest[label[rest] != label[i]]):  # a component is left as soon as one of its rows is linked
            part, rest, size = rest[:size], rest[size:], min(4 * size, 4096)
            hit = part[np.bitwise_count(x[part] ^ x[i]) <= radius]
            if len(hit):
                for j in hit[np.unique(label[hit], return_index=True)[1]]:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return out


def _small(keys: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, all runs at once: each row with the row ``shift`` further on."""
    a, b, at, shift = [], [], np.arange(len(x)), 1
    while True:
        at = at[at + shift < len(x)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        hit = at[np.bitwise_count(x[at] ^ x[at + shift]) <= radius]
        a.append(x[hit])
        b.append(x[hit + shift])
        shift += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def links(fps: DataFrame, radius: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """(a, b) long: a spanning subset, by bucket, of the pairs of distinct fingerprints within ``radius`` (at most 4) bits."""
    if not 0 <= radius <= 4:
        raise ValueError("the keys cover at most 4 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in slices(batches, 20_000):
            fp = batch.column(0).to_numpy()
            row, key = keys_of(fp.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(a, b, key=None, block=None) -> pa.RecordBatch:  # noqa: ANN001
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, 0 if key is None else key)), pa.array(np.full(n, -1 if block is None else block))], ["a", "b", "key", "block"])

        def bucket(key: int, x: np.ndarray) -> pa.RecordBatch:
            got = np.array(forest(x, radius), dtype=np.int64).reshape(-1, 2)
            return given(x[got[:, 0]], x[got[:, 1]])

        held_key, held, block = None, [], 0  # a bucket that may go on in the next batch
        for batch in slices(batches, 200_000):
            key, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            if held_key is not None and key[0] != held_key:
                yield bucket(held_key, np.concatenate(held)) if not block else given(y := np.concatenate(held), y, held_key, block)
                held_key, held, block = None, [], 0
            small = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e == len(key) or (s == 0 and held_key is not None):
                    held_key = int(key[s])
                    held.append(x[s:e])
                    while sum(map(len, held)) > bucket_rows:  # a hot bucket: its blocks are compared later
                        y = np.concatenate(held)
                        yield given(y[:bucket_rows], y[:bucket_rows], held_key, block)
                        held, block = [y[bucket_rows:]], block + 1
                    if e < len(key):
                        y = np.concatenate(held)
                        yield given(y, y, held_key, block) if block else bucket(held_key, y)
                        held_key, held, block = None, [], 0
                elif e - s > bucket_rows:
                    for k, at in enumerate(range(s, e, bucket_rows)):
                        yield given(x[at : min(e, at + bucket_rows)], x[at : min(e, at + bucket_rows)], int(key[s]), k)
                elif e - s > 32:
                    yield bucket(int(key[s]), x[s:e])
                elif e - s > 1:
                    small.append((s, e))
            if small:
                at = np.concatenate([np.arange(s, e) for s, e in small])
                yield given(*_small(key[at], x[at], radius))
        if held_key is not None:
            y = np.concatenate(held)
            yield given(y, y, held_key, block) if block else bucket(held_key, y)

    keyed = fps.select("fp").distinct().mapInArrow(spread, "key long, fp long")
    met = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long, key long, block long")
    met = written(met, "met")
    return met.where("block < 0").select("a", "b").union(_blocks(met.where("block >= 0"), radius)).distinct()


def _blocks(hot: DataFrame, radius: int) -> DataFrame:
    """Links within hot buckets: each pair of blocks is a group of its own."""
    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = hot.join(last, "key").select(F.col("a").alias("fp"), "key", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    pairs = pairs.select("fp", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["block", "fp"])
        x = pdf["fp"].to_numpy().view(np.uint64)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        got = np.array(forest(x, radius, None if i == j else int((pdf["block"] == i).sum())), dtype=np.int64).reshape(-1, 2)
        import pandas as pd

        return pd.DataFrame({"a": x[got[:, 0]].view(np.int64), "b": x[got[:, 1]].view(np.int64)})

    return pairs.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """A row for each document: id, fingerprint (16 hex digits), component_id (least id reachable by links)."""
    fps = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    least = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(fps, radius)).withColumnRenamed("node", "fp")
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")  # read from files, a root of very many fingerprints can be split in the join
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(group, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """One row, of the least id, of each component, also where ids repeat; rows without an id stay."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].cast("long").alias("id"), F.struct("*").alias("row")), "rows")
    texts = rows.select("uid", F.col("row")[text_col].alias("text"))
    found = near_duplicates(texts, "uid", "text", **options).select("uid", "component_id")
    known = rows.where("id is not null").select("uid", "id").join(found, "uid")
    first = known.groupBy("component_id").agg(F.min(F.struct("id", "uid")).alias("first")).select("first.uid")
    return rows.select("uid", "row").join(first.union(rows.where("id is null").select("uid")), "uid").select("row.*")
