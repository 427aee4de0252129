"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from all training texts and
quantised by a logarithm of base ``BASE``: an n-gram of level q is put into the
filter q times, as (n-gram, 1) .. (n-gram, q). A count is read back by probing
levels from 1 until one is missing. The filter consists of segments of ``2**SEGMENT``
bits; their number is the power of two that holds every level of every n-gram counted
with each segment at most half full, so nothing is left out at any size and the
filter grows with the corpus. Segments are made by the tasks that hold their n-grams,
one at a time.

N-grams travel in blocks: a row holds the n-grams of some texts that begin with the
same ``PART`` bits, in order, and the rows of a part are merged where they meet.

Up to ``most_bits`` in all (64 MiB) the filter is broadcast and probed where the texts
are. A larger one isn't broadcast: texts are dealt into slices, the distinct n-grams
of each slice go to their segments, and the levels found come back to the slice. There
are ``2**GROUP`` groups of neighbouring segments at most and a slice sends a row to
each, so rows are as many as slices and don't grow with the filter too. Both ways ask
the same filter and give the same scores.

A text's probability is a mixture of whole-text models: words alone, and words
mixed with pairs at several weights. It costs a text at most the logarithm of
their number against the best of them. A pair's count is held to those of its
words, which removes most false hits of the filter.

The exact base score needs exact counts of every word. Words with at least
N / ``frequent`` tokens, which are at most ``frequent`` words, are broadcast; the
other words of each text meet their counts in a join.

Null text: empty, one end token. Repeated rows are scored each. A null id is in
no held-out fold and trains. Without training texts N = V = 0. An empty table
gives no rows. Very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, removed, save, scratch, slices, written

BASE = 1.5
#: Weights of pairs in the mixed models; 0 is words alone.
WEIGHTS = (0.0, 0.02, 0.2, 0.6, 0.9, 0.99)
#: Bits set for an n-gram at level 1, where a false hit makes an n-gram of none, and at each level above.
FIRST, PROBES = 6, 3
#: Segments have ``2**SEGMENT`` bits, of which ``FULL`` are set at most (repeats counted); a filter has ``2**LEAST`` bits at least.
SEGMENT, LEAST = 20, 24
FULL = int((1 << SEGMENT) * np.log(2) * 0.95)
#: Counts are merged in ``2**PART`` parts; a filter is asked in ``2**GROUP`` groups of segments at most (GROUP <= PART).
PART, GROUP = 12, 10
_WORD = np.uint64((1 << 64) - 2)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_LEVEL = np.uint64(0x165667B19E3779F9)


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _typical(most: int = 128) -> np.ndarray:
    """For each level the middle of the counts it holds; 0 for level 0."""
    out = np.zeros(most)
    for q in range(1, most):
        low, high = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
        out[q] = (low + max(low, high)) / 2
    return out


TYPICAL = _typical()


def segment_of(grams: np.ndarray, bits: int) -> np.ndarray:
    """The segment of each n-gram: its first bits."""
    k = bits - SEGMENT
    return (grams >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(grams), np.int64)


def _probe(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th place, within its segment, of a hash of (n-gram, level)."""
    step = np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1)) if i else np.uint64(0)
    return (h + step) & np.uint64((1 << SEGMENT) - 1)


def _hash(grams: np.ndarray, levels: np.ndarray | int) -> np.ndarray:
    return mix(grams + np.asarray(levels).astype(np.uint64) * _LEVEL)


def probes(q: int) -> int:
    return FIRST if q == 1 else PROBES


def bits_set(levels: np.ndarray) -> int:
    """How many bits n-grams of these levels set, repeats counted."""
    return int((levels > 0).sum()) * (FIRST - PROBES) + int(levels.sum()) * PROBES


class Filter:
    """Segments ``first``, ``first`` + 1, .. of a filter of ``2**bits`` bits: all of them, or a single one."""

    def __init__(self, data: np.ndarray, bits: int, first: int = 0):
        self.data, self.bits, self.first = data, bits, first

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Probes level after level until one is missing; later probes only where earlier ones hit."""
        base = (segment_of(grams, self.bits) - self.first).astype(np.uint64) << np.uint64(SEGMENT)
        out, at, q = np.zeros(len(grams), np.int64), np.arange(len(grams)), 1
        while len(at) and q < len(TYPICAL):
            h = _hash(grams[at], q)
            for i in range(probes(q)):
                place = base[at] | _probe(h, i)
                hit = np.flatnonzero(self.data[place >> np.uint64(3)] & (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))
                at, h = at[hit], h[hit]
            out[at] = q
            q += 1
        return out


def segment_bits(grams: np.ndarray, levels: np.ndarray) -> bytes:
    """The bytes of one segment with every level of its n-grams."""
    flat = np.zeros(1 << SEGMENT, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        h = _hash(grams[levels >= q], q)
        for i in range(probes(q)):
            flat[_probe(h, i).astype(np.int64)] = 1
    return np.packbits(flat, bitorder="little").tobytes()


def bits_for(needed: int) -> int:
    """The size of a filter in which so many bits are set."""
    bits = LEAST
    while needed > FULL << (bits - SEGMENT):
        bits += 1
    return bits


def hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, which of them each token is, each text closed by an end token, and where texts begin (and the end).

    A blank after the last word makes the splitter close a text with an empty word, which is the end token.
    """
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.coalesce(texts, "")))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), "", pc.binary_join_element_wise(bare, "", " ")))
    words = lists.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return hashes(words.dictionary), words.indices.to_numpy(zero_copy_only=False), bounds


def pairs_of(tokens: np.ndarray, bounds: np.ndarray, end: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The token before each (an end before the first) and the pair's hash, which is odd; those of words are even."""
    before = np.concatenate([[end], tokens[:-1]]).astype(np.uint64)
    before[bounds[:-1]] = end
    return before, mix(before * _PAIR + tokens) | np.uint64(1)


def starts_of(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` bits that n-grams in order begin with, each once, and where those begin (and the end)."""
    first = (grams >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(grams), np.int64)
    at = np.flatnonzero(np.diff(first, prepend=-1))
    return first[at], np.append(at, len(grams))


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values; ``at`` is where they begin (and the end)."""
    buffers = [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers)


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary rows end to end (a null has none), and where rows begin (and the end)."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return raw.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def stretches(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    at = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip(at[:-1], at[1:], strict=True) if len(keys) else iter(())


def by_key(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of rows in the order of a key: each key, and the values of all its rows end to end for each binary column beside it."""
    held, parts = -1, []
    for batch in batches:
        keys, columns = batch.column(0).to_numpy(), [unpacked(c, k) for c, k in zip(batch.columns[1:], kinds, strict=True)]
        for a, b in stretches(keys):
            if keys[a] != held and parts:
                yield held, [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts = []
            held = int(keys[a])
            parts.append([values[at[a] : at[b]] for values, at in columns])
    if parts:
        yield held, [np.concatenate(x) for x in zip(*parts, strict=True)]


class Slice:
    """Tokens of some texts, their distinct words, and the distinct n-grams (in order) that a filter is asked for; without ``places`` nothing can be scored."""

    def __init__(self, texts: pa.Array, places: bool = True):
        self.end = hashes(pa.array([""]))[0]
        words, at, self.bounds = tokens_of(texts)
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.at = words[order], rank[at]
        both = np.concatenate([mix(self.words) & _WORD, pairs_of(words[at], self.bounds, self.end)[1]])
        if places:
            self.grams, self.places = np.unique(both, return_inverse=True)
        else:
            both.sort()
            self.grams = both[np.concatenate([[True], both[1:] != both[:-1]])]

    def scores(self, levels: np.ndarray, total: float) -> np.ndarray:
        """log10 probability of each text by the mixture, from the levels of ``grams``."""
        at, bounds, found = self.at, self.bounds, levels[self.places]
        word_levels, pair_levels = found[: len(self.words)], found[len(self.words) :]
        starts, length, docs_n = bounds[:-1], np.diff(bounds), len(bounds) - 1
        doc = np.repeat(np.arange(docs_n), length)
        seen = TYPICAL[word_levels]
        alone = (seen[at] + 0.5) / total
        of_end = seen[np.searchsorted(self.words, self.end)]
        first = np.concatenate([[of_end], seen[at[:-1]]])
        first[starts] = of_end
        given = np.minimum(TYPICAL[pair_levels], np.minimum(first, seen[at])) / np.maximum(first, 1)
        plain = np.log10(alone)
        paired = np.flatnonzero(given)
        ratio, where, sums = given[paired] / alone[paired], doc[paired], np.add.reduceat(plain, starts)
        logs = np.stack([sums + length * np.log10(1 - w) + np.bincount(where, np.log10(w / (1 - w) * ratio + 1), docs_n) for w in WEIGHTS])
        top = logs.max(axis=0)
        return top + np.log10((10.0 ** (logs - top)).mean(axis=0))


class LanguageModel:
    """N, V, the filter's segments as a table and, if small enough, whole; the frequent words' exact counts, and all words' as a table."""

    def __init__(self, n: int, v: int, bits: int, segments: DataFrame, data: np.ndarray | None, frequent: tuple[np.ndarray, np.ndarray], counts: DataFrame):
        self.n, self.v, self.bits, self.segments, self.data, self.frequent, self.counts = n, v, bits, segments, data, frequent, counts


def fit(docs: DataFrame, training: Column, most_bits: int = 29, frequent: int = 1 << 21, text_col: str = "text") -> LanguageModel:
    """Counts all tokens and pairs of the rows where ``training`` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = hashes(pa.array([""]))[0]
        for batch in slices(batches, 50_000, 4_000_000):
            distinct, at, bounds = tokens_of(batch.column(0))
            tokens = distinct[at]
            h, c = np.unique(np.concatenate([mix(tokens) & _WORD, pairs_of(tokens, bounds, end)[1]]), return_counts=True)
            part, at = starts_of(h, PART)
            yield pa.RecordBatch.from_arrays([pa.array(part), packed(h, at), packed(c.astype(np.int32), at)], ["part", "grams", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (h, c) in by_key(batches, np.uint64, np.int32):
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            whole = np.array([0, len(at)])
            yield pa.RecordBatch.from_arrays([pa.array([part]), packed(h[at], whole), packed(np.add.reduceat(c[order].astype(np.int64), at), whole)], ["part", "grams", "counts"])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = needed = 0
        for batch in batches:
            (h, _), (c, _) = unpacked(batch.column(0), np.uint64), unpacked(batch.column(1), np.int64)
            words = h & np.uint64(1) == 0
            n, v, needed = n + int(c[words].sum()), v + int(words.sum()), needed + bits_set(level(c))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, v, needed)], ["n", "v", "needed"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h, _), (c, _) = unpacked(batch.column(0), np.uint64), unpacked(batch.column(1), np.int64)
            at = h & np.uint64(1) == 0
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at])], ["h", "c"])

    schema = "part long, grams binary, counts binary"
    rows = docs.where(training).select(docs[text_col].cast("string")).mapInArrow(count, schema)
    merged = rows.repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)
    path = scratch(docs.sparkSession, "grams")
    save(merged, path)
    sums = docs.sparkSession.read.schema(merged.schema).parquet(path)
    counts = written(sums.select("grams", "counts").mapInArrow(words, "h long, c long"), "words")
    n, v, needed = (x or 0 for x in sums.select("grams", "counts").mapInArrow(facts, "n long, v long, needed long").agg(F.sum("n"), F.sum("v"), F.sum("needed")).first())
    bits = bits_for(needed)
    k = bits - SEGMENT

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (h, c) in by_key(batches, np.uint64, np.int64):
            q, (segment, at) = level(c), starts_of(h, k)
            for s, a, b in zip(segment.tolist(), at[:-1], at[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([segment_bits(h[a:b], q[a:b])], pa.binary())], ["segment", "bits"])

    grouped = sums.select(F.shiftright("part", PART - min(k, GROUP)).alias("group"), "part", "grams", "counts")
    grouped = grouped.repartition("group").sortWithinPartitions("part").select("group", "grams", "counts")
    made = written(grouped.mapInArrow(build, "segment long, bits binary"), "filter")
    removed(docs.sparkSession, path)
    data = None
    if bits <= most_bits:
        data, each = np.zeros(1 << (bits - 3), np.uint8), 1 << (SEGMENT - 3)
        for r in made.toLocalIterator():
            data[r.segment * each : (r.segment + 1) * each] = np.frombuffer(r.bits, np.uint8)
    # at most ``frequent`` words, for their counts add up to n; 16 bytes each
    common = counts.where(F.col("c") >= max(1, -(-n // frequent))).toArrow()
    h, c = common.column("h").to_numpy().view(np.uint64), common.column("c").to_numpy()
    order = np.argsort(h)
    return LanguageModel(n, v, bits, made, data, (h[order], c[order]), counts)


_NAMES = ["h", "uid", "times", "id", "n_tokens", "known", "base", "score"]
_SCORED = "h long, uid long, times long, id long, n_tokens long, known long, base double, score double"


def _rows(some: Slice, uid: np.ndarray, ids: pa.Array, scores: np.ndarray, total: float, common: np.ndarray, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text with what the frequent words say of its base score, and one for each other word of a text."""
    words, at, bounds, docs_n = mix(some.words) & _WORD, some.at, some.bounds, len(some.bounds) - 1
    doc = np.repeat(np.arange(docs_n), np.diff(bounds))
    order = np.argsort(words)  # a search in order stays in the cache
    place = np.empty(len(words), np.int64)
    place[order] = np.minimum(np.searchsorted(common, words[order]), max(0, len(common) - 1))
    here = common[place] == words if len(common) else np.zeros(len(words), bool)
    c = np.where(here, exact[place] if len(common) else 0, 0)
    known = here[at]
    base = np.add.reduceat(np.where(known, np.log10((c[at] + 0.5) / total), 0.0), bounds[:-1])
    count = np.add.reduceat(known.astype(np.int64), bounds[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(mix(uid.astype(np.uint64)).view(np.int64)), pa.array(uid), pa.array(np.zeros(docs_n, np.int64)), ids, pa.array(np.diff(bounds)), pa.array(count), pa.array(base), pa.array(scores)], _NAMES)
    rest = np.flatnonzero(~known)
    if len(rest):
        key, times = np.unique(doc[rest] * np.int64(len(words)) + at[rest], return_counts=True)
        none = lambda t: pa.nulls(len(key), t)
        yield pa.RecordBatch.from_arrays([pa.array(words[key % len(words)].view(np.int64)), pa.array(uid[key // len(words)]), pa.array(times.astype(np.int64)), *(none(pa.int64()) for _ in range(3)), none(pa.float64()), none(pa.float64())], _NAMES)


def _total(n: int, v: int) -> float:
    return float(n + 0.5 * (v + 1))


def _by_broadcast(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``_rows`` with the whole filter at hand."""
    sent = texts.sparkSession.sparkContext.broadcast((_total(model.n, model.v), model.bits, model.data, model.frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bits, data, frequent = sent.value
        kept = Filter(data, bits)
        serial = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 2000, 1_500_000):
            some = Slice(batch.column(1))
            scores = some.scores(kept.levels(some.grams), total)
            uid = serial + np.arange(batch.num_rows)
            serial += batch.num_rows
            yield from _rows(some, uid, batch.column(0), scores, total, *frequent)

    return texts.mapInArrow(run, _SCORED)


def questions(made: DataFrame, bits: int) -> DataFrame:
    """The distinct n-grams of each slice, a row for each group of the filter's segments."""
    k = min(bits - SEGMENT, GROUP)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = Slice(texts.values, places=False).grams
                group, at = starts_of(grams, k)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.full(len(group), number)), packed(grams, at)], ["group", "slice", "bytes"])

    return made.select("slice", "texts").mapInArrow(asked, "group long, slice long, bytes binary")


def answers(asked: DataFrame, segments: DataFrame, bits: int) -> DataFrame:
    """The levels that a filter's segments find for rows of ``questions``, in the same order."""
    each = max(0, bits - SEGMENT - GROUP)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = -1, None
        for batch in batches:
            group, number, segment = (batch.column(i).to_numpy() for i in range(3))
            raw, at = unpacked(batch.column(3), np.uint8)
            for a, b in stretches(group):
                if group[a] != held:
                    held = int(group[a])
                    kept = Filter(np.zeros(1 << (SEGMENT - 3 + each), np.uint8), bits, held << each)
                first = a + int((number[a:b] < 0).sum())
                for i in range(a, first):
                    place = int(segment[i] - kept.first) << (SEGMENT - 3)
                    kept.data[place : place + at[i + 1] - at[i]] = raw[at[i] : at[i + 1]]
                if first < b:
                    grams = raw[at[first] : at[b]].view(np.uint64)
                    q = np.concatenate([kept.levels(grams[x : x + 200_000]).astype(np.int8) for x in range(0, len(grams), 200_000)])
                    yield pa.RecordBatch.from_arrays([pa.array(number[first:b]), pa.array(group[first:b]), packed(q, (at[first : b + 1] - at[first]) // 8)], ["slice", "group", "levels"])

    own = segments.select(F.shiftright("segment", each).alias("group"), F.lit(-1).cast("long").alias("slice"), "segment", F.col("bits").alias("bytes"))
    both = own.union(asked.select("group", "slice", F.lit(-1).cast("long"), "bytes"))
    return both.repartition("group").sortWithinPartitions("group", "slice").mapInArrow(answered, "slice long, group long, levels binary")


def _by_segment(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """The same for a filter too large to broadcast: n-grams travel to its segments and levels back."""
    sent = texts.sparkSession.sparkContext.broadcast((_total(model.n, model.v), model.frequent))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 28
        for batch in slices(batches, 2000, 3_000_000):
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(ends, batch.column(0)), pa.ListArray.from_arrays(ends, batch.column(1))], ["slice", "ids", "texts"])
            number += 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, frequent = sent.value
        held: list = []  # slice, ids, texts
        parts: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                some = Slice(held[2])
                scores = some.scores(np.concatenate(parts).astype(np.int64), total)
                yield from _rows(some, (held[0] << 11) + np.arange(len(held[1])), held[1], scores, total, *frequent)
            held.clear()
            parts.clear()

        for batch in batches:
            (levels, at), ends = unpacked(batch.column(4), np.int8), [-1, *np.flatnonzero(batch.column(1).to_numpy() < 0).tolist(), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a >= 0:
                    yield from close()
                    held += [batch.column(0)[a].as_py(), batch.column(2)[a].values, batch.column(3)[a].values]
                parts.append(levels[at[a + 1] : at[b]])
        yield from close()

    made = written(texts.mapInArrow(sliced, "slice long, ids array<long>, texts array<string>"), "slices")
    levels = written(answers(questions(made, model.bits), model.segments, model.bits), "levels")
    whole = made.select("slice", F.lit(-1).cast("long").alias("group"), "ids", "texts", F.lit(None).cast("binary").alias("levels"))
    back = whole.union(levels.select("slice", "group", F.lit(None).cast("array<long>"), F.lit(None).cast("array<string>"), "levels"))
    return back.repartition("slice").sortWithinPartitions("slice", "group").mapInArrow(scored, _SCORED)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score (exact, words alone) and score (the model's), each log10."""
    texts = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    found = _by_segment(texts, model) if model.data is None else _by_broadcast(texts, model)
    counts = model.counts.withColumnRenamed("c", "exact")
    joined = found.join(counts, "h", "left")
    part = F.coalesce("base", F.col("times") * F.log10((F.coalesce("exact", F.lit(0)) + 0.5) / _total(model.n, model.v)))
    known = F.coalesce("known", F.when(F.col("exact") > 0, F.col("times")).otherwise(0))
    out = joined.groupBy("uid").agg(F.max("id").alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(part).alias("base_score"), F.max("score").alias("score"))
    return out.select(id_col, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, rest: int = 1, **options) -> DataFrame:  # noqa: ANN003
    """Learns from rows outside the fold, scores all; ``held_out`` tells the fold."""
    model = fit(docs, ~fold(id_col, parts, rest), text_col=text_col, **options)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, fold(id_col, parts, rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
