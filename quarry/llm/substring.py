"""Repeated passages across documents: seed and extend on winnowed anchors.

Every window of ``length`` words picks the least hash among its ``anchor``-word
grams (winnowing), so equal windows pick equal anchors. Consecutive windows with
one anchor are a run; the words they cover are the anchor extended both ways as
far as those windows reach. Documents meet on anchors:

* two runs with equal extensions are equal in all their windows: the one in the
  document of smaller id stands, the other's windows are repeats at once;
* an anchor with different extensions is compared window by window, by the runs
  that stand, to find how far each match reaches.

An anchor that is frequent in a sample of the documents (a stock phrase in ever new
surroundings) isn't met by itself, for all its runs would land in one task: its runs
meet by anchor and extension, and all that stand are compared window by window. That
is what their meeting would have led to, so the sample decides where rows go and
changes no result.

Neighbouring repeats join into the maximal ones. Rows meet by key through one
window function each, after each batch of documents has kept only its own least
document for every key, so an extremely common passage sends a row for each batch
instead of each document. No pairs of documents are made. Texts cross the network
once: both joins by id share an exchange.

Null text counts as empty; a null id is no source and loses nothing. Rows with
equal id and text are treated alike; a window is a repeat only of a smaller id,
so repeats within a document and among equal ids stay. Texts under ``length``
words stay whole. Very long texts are handled in numpy, with no cap. An empty
table gives no rows. Hashes are of 64 bits; keys join two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, mix, slices, utf8, written

#: Documents looked at for frequent anchors, the least count there, and the most anchors kept.
SAMPLED, FREQUENT, MOST = 20_000, 20, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Grams:
    """Hashes of any stretch of words in a batch of documents, by prefix sums of a polynomial."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes) * np.cumprod(up)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _BASE)


def runs(grams: Grams, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document's index, first window, windows, anchor hash, extension hash.

    ``bounds``: where each document's words begin, and the end.
    """
    n, reach = int(bounds[-1]), length - anchor
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - anchor + 1)
    gram = grams(at, at + anchor)
    m = n - length + 1
    least, where = gram[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, reach + 1):
        less = gram[j : j + m] < least
        least[less] = gram[j : j + m][less]
        where[less] = j
    where += np.arange(m)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:m]
    valid = np.arange(m) + length <= bounds[1:][doc]
    first = valid.copy()
    first[1:] &= (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    windows = np.add.reduceat(valid.astype(np.int64), starts)
    return doc[starts], starts - bounds[doc[starts]], windows, gram[where[starts]], grams(starts, starts + windows + length - 1)


def _packed(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return start << 4 | (windows - 1)


def _batch(texts: list[bytes], hasher: WordHash) -> tuple[Grams, np.ndarray]:
    words: list[bytes] = []
    bounds = [0]
    for t in texts:
        words += t.split()
        bounds.append(len(words))
    return Grams(hasher(words)), np.array(bounds)


def _least_first(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For each row the least id of its key within the batch."""
    order = np.lexsort([ids, *keys[::-1]])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def frequent_anchors(texts: DataFrame, length: int, anchor: int, id_col: str, text_col: str) -> np.ndarray:
    """Anchors of at least ``FREQUENT`` documents of a sample, in order."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in slices(batches, 4000):
            doc, _, _, key, _ = runs(*_batch(utf8(batch.column(0)), hasher), length, anchor)
            if len(doc):
                first = np.lexsort([doc, key])
                new = np.concatenate([[True], (key[first][1:] != key[first][:-1]) | (doc[first][1:] != doc[first][:-1])])
                h, c = np.unique(key[first][new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    each = -(-texts.count() // SAMPLED)
    if each > 1:
        texts = texts.where(F.pmod(F.xxhash64(id_col), F.lit(each)) == 0)
    counts = texts.select(text_col).mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    return np.sort(counts.orderBy(F.desc("c"), "h").limit(MOST).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def repeats(docs: DataFrame, length: int = 13, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text", marked: bool = True) -> DataFrame:
    """(doc, mark, at): stretches of windows that also start in a document of smaller id, packed as in ``_packed``; ``mark`` is the text's hash, 0 unless ``marked``, which may only be unset where ids don't repeat."""
    if not 0 < anchor < length <= anchor + 16:
        raise ValueError("a run holds at most 16 windows")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in slices(batches, 4000):
            texts, ids, marks = utf8(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            doc, start, windows, key, span = runs(*_batch(texts, hasher), length, anchor)
            if not len(doc):
                continue
            own = ids[doc]
            done = _least_first([key, span], own) < own  # a smaller id of this batch has the same run
            often = np.isin(key, sent.value) & ~done
            key = np.where(often, mix(key * _BASE + span), key)
            key = np.where(done, mix(own.view(np.uint64) * _BASE + start.astype(np.uint64)), key)  # these no longer need to meet
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(own), pa.array(marks[doc]), pa.array(_packed(start, windows)), pa.array(np.where(done, 1, np.where(often, 2, 0)).astype(np.int8))],
                ["anchor", "span", "doc", "mark", "at", "flag"],
            )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in slices(batches, 4000):
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            grams, bounds = _batch(utf8(batch.column(1)), hasher)
            rows = []
            for k, packed in enumerate(batch.column(3).to_pylist()):
                p = np.array(packed, np.int64)
                n = (p & 15) + 1
                first = np.repeat(p >> 4, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append((np.full(len(first), k), first))
            doc, start = (np.concatenate(x) for x in zip(*rows, strict=True))
            key = grams(start + bounds[doc], start + bounds[doc] + length)
            own = ids[doc]
            done = _least_first([key], own) < own
            key = np.where(done, mix(own.view(np.uint64) * _BASE + start.astype(np.uint64)), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(marks[doc]), pa.array(start << 4), pa.array(done)], ["key", "doc", "mark", "at", "done"])

    texts = _texts(docs, id_col, text_col, marked)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(texts, length, anchor, id_col, text_col))
    seeds = texts.mapInArrow(seed, "anchor long, span long, doc long, mark long, at long, flag byte")
    by_anchor = Window.partitionBy("anchor").orderBy("span", "doc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_span = Window.partitionBy("anchor", "span").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = seeds.withColumns({"low": F.min("span").over(by_anchor), "high": F.max("span").over(by_anchor), "n": F.count("*").over(by_anchor)}).where("n > 1 or flag > 0")
    met = met.withColumn("first", F.min("doc").over(by_span))
    met = met.select("doc", "mark", "at", ((F.col("flag") == 1) | (F.col("first") < F.col("doc"))).alias("repeat"), ((F.col("flag") == 2) | (F.col("low") != F.col("high"))).alias("open"))
    met = written(met.where("repeat or open"), "runs")

    opened = _with(texts, met.where("not repeat"), id_col, "inner").select(id_col, text_col, "mark", "at")
    parts = opened.mapInArrow(extend, "key long, doc long, mark long, at long, done boolean")
    by_key = Window.partitionBy("key").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("first", F.min("doc").over(by_key)).where("done or first < doc")
    return met.where("repeat").select("doc", "mark", "at").union(parts.select("doc", "mark", "at"))


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether any id has several rows; only ids travel."""
    return not docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].cast("long")).count().where("count > 1").isEmpty()


def _mark(text: Column, marked: bool) -> Column:
    """The text's hash, which tells apart the texts of one id; a constant, which costs no room, where ids don't repeat."""
    return F.xxhash64(text) if marked else F.lit(0).cast("long")


def _texts(docs: DataFrame, id_col: str, text_col: str, marked: bool) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias(id_col), text.alias(text_col), _mark(text, marked).alias("mark")).where(F.col(id_col).isNotNull())


def _with(texts: DataFrame, stretches: DataFrame, id_col: str, how: str) -> DataFrame:
    """``texts`` (id, text's 64-bit mark, ...) with an array ``at`` of its stretches; a mark tells apart the texts of one id."""
    at = stretches.groupBy("doc", F.col("mark").alias("of")).agg(F.collect_set("at").alias("at"))
    return texts.join(at, (texts[id_col] == at["doc"]) & (texts["mark"] == at["of"]), how)


def covered(n: int, packed: list[int] | None, length: int) -> np.ndarray:
    """Which of a document's ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    if packed:
        p = np.array(packed, np.int64)
        np.add.at(edge, p >> 4, 1)
        np.add.at(edge, (p >> 4) + (p & 15) + length, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, length: int = 13, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document without the words of repeated windows: id, n_words, n_removed, kept_text (or kept_sha256)."""
    kept = "kept_sha256" if digest else "kept_text"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, packed in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                gone = covered(len(words), packed, length) if packed else np.zeros(0, bool)
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if packed else words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(left).hexdigest() if digest else left.decode()))
            counts, removed, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], [id_col, "n_words", "n_removed", kept])

    marked = ids_repeat(docs, id_col)
    joined = _with(_texts(docs, id_col, text_col, marked), repeats(docs, length, anchor, id_col, text_col, marked), id_col, "left").select(id_col, text_col, "at")
    unnamed = docs.where(docs[id_col].isNull()).select(F.lit(None).cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col), F.lit(None).cast("array<long>").alias("at"))
    return joined.union(unnamed).mapInArrow(cut, f"{id_col} long, n_words long, n_removed long, {kept} string")


def cut_repeats(docs: DataFrame, length: int = 13, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every column and ``n_removed`` (one of that name is replaced); texts that lose words have the others joined by a space, the rest stay as they are."""
    from pyspark.sql.types import LongType, StringType, StructType

    docs = docs.drop("n_removed")
    text, marked = docs[text_col].cast("string"), ids_repeat(docs, id_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), _mark(text, marked).alias("mark"), F.struct("*").alias("row"))
    joined = _with(rows, repeats(docs, length, anchor, id_col, text_col, marked), "id", "left").select("text", "at", "row")
    columns, place = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts = [], []
            for text, raw, packed in zip(batch.column(0).to_pylist(), utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = raw.split() if packed else []
                gone = covered(len(words), packed, length)
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode() if gone.any() else text)
                counts.append(int(gone.sum()))
            cols = batch.column(2).flatten()
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*columns, "n_removed"])

    fields = [f if f.name != text_col else type(f)(f.name, StringType()) for f in docs.schema.fields]
    return joined.mapInArrow(cut, StructType(fields).add("n_removed", LongType()))
