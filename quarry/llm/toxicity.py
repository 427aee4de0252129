"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs with one word between, lower-cased
(A-Z), hashed into ``2**bits`` places; each counts once in a text. FTRL-proximal
keeps a learning rate for every place, and its L1 term leaves most weights exactly
zero, so what is broadcast is a short list of places and weights, at most
``2**bits`` of them.

The model is fitted on a bounded sample of labelled rows (``most_rows``, those of
least id hash, as far as ``most_features`` go in that order); features are made where
the texts are and learning runs in one task over that sample, so a table gives the same
model however it is partitioned. Every text is scored whole.

Null text counts as empty; a text without words gets the model's bias. Several
labels of one id: the greatest counts. Rows without id or label aren't learned
from. Without labels of both kinds the score is the share of label 1 (0 if there
is none). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, bounded_ids, mix, slices, utf8

_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def places(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct feature places of a text given its words' hashes."""
    shift = np.uint64(64 - bits)
    found = [mix(words), mix(words[:-1] * _PAIR + words[1:]), mix(words[:-2] * _SKIP + words[2:] + _PAIR)]
    return np.unique(np.concatenate(found) >> shift).astype(np.int32)


@dataclass
class Model:
    bits: int
    bias: float
    place: np.ndarray
    weight: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.place] = self.weight
        return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 3, seed: int = 11) -> Model:
    """FTRL-proximal over sparse binary rows; the bias is learned without L1."""
    n, z = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_n = bias_z = 0.0
    order = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    bias = 0.0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            w = weights(z[x], n[x])
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - labels[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - sigma * w
            n[x] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g * g
    w = weights(z, n)
    place = np.flatnonzero(w)
    return Model(bits, float(bias), place.astype(np.int32), w[place].astype(np.float32))


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, bits: int = 20, most_rows: int = 16_000, most_features: int = 40_000_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model learned from at most ``most_rows`` labelled rows where ``usable`` (a condition on the id) holds; ids of more than 100 rows aren't learned from."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        chosen = chosen.where(usable)
    chosen = chosen.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    chosen = bounded_ids(docs, chosen, most_rows, id_col)
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col(id_col)).select(F.col("_id").cast("long"), "_text", "_y")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in slices(batches):
            found = [places(hasher(t.lower().split()), bits).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "y", "x"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        room = most_features
        for batch in batches:  # in order of the id's hash
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                room -= len(row[2]) // 4
                if room >= 0:
                    rows.append(row)
            if room < 0:
                break
        rows.sort()
        y = np.array([r[1] for r in rows], np.float64)
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            model = Model(bits, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0, np.int32), np.zeros(0, np.float32))
        else:
            model = ftrl([np.frombuffer(r[2], np.int32) for r in rows], y, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.place.tobytes()], pa.binary()), pa.array([model.weight.tobytes()], pa.binary())], ["bias", "place", "weight"])

    ordered = texts.mapInArrow(featured, "id long, y int, x binary").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "x")
    got = ordered.mapInArrow(learned, "bias double, place binary, weight binary").first()
    if got is None:  # no row reached the task
        return Model(bits, float(np.log(1e-9)), np.zeros(0, np.int32), np.zeros(0, np.float32))
    return Model(bits, got.bias, np.frombuffer(got.place, np.int32), np.frombuffer(got.weight, np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Every row and column of ``docs`` with the score (a column of that name is replaced)."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.place, model.weight))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        weights, hasher = model.table(), WordHash()
        for batch in slices(batches):
            scores = []
            for t in utf8(batch.column(at)):
                words = t.lower().split()
                s = model.bias + (float(weights[places(hasher(words), model.bits)].sum()) if words else 0.0)
                scores.append(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, s)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))
