"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence; the program covers the
histogram with the fewest configurations. It has a row for each length, so its size does not
grow with the corpus, and the driver solves it:

* Prices of lengths fall multiplicatively with their coverage. Each step prices all
  configurations by a knapsack over capacities and adds those of nearly the best value, each
  by a part of what its scarcest length needs. A burn-in moves the prices, a second stage with
  smaller steps gathers the solution. Total price over the best configuration's value is a
  bound under which no packing gets.
* Rounding keeps whole multiples of the solution, scaled by its coverage, and fills the rest:
  the longest length left opens a sequence, a knapsack at the program's prices over what is
  left completes it, as many times as the lengths allow. Of a few scales (from all of the
  solution down to its prices only) the one with the fewest sequences stands.

Each length's documents are numbered across all partitions (a counter in each partition, and
sums of the counters of those before it), and a document's number says which sequence of which
configuration takes it. No document meets another in a task; only the histogram reaches
the driver.

Documents longer than a sequence are cut into full ones, the first piece may be shorter; no
other document is cut. Null, empty: one end id alone. Repeated rows and ids, null ids: each
row is packed. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import encode

#: Stages of the weights: how fast prices fall, the part of a length's count that one step may cover, rounds of coverage.
STAGES = ((1.0, 0.5, 3.0), (0.2, 0.25, 4.0))
#: Steps of a stage at most; configurations added in a step, of at least this part of the best value.
STEPS, COLUMNS, NEAR = 250, 32, 0.995
#: Parts of lengths' coverages that the solution is scaled by before it is rounded down; None keeps the prices only.
SCALES = (0.0, 0.1, 0.5, None)

Config = tuple[tuple[int, int], ...]  # (length, times), by length


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best total price within each capacity, and a length that it uses last (0: a place left empty)."""
    best, back, used = np.zeros(capacity + 1), np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)  # back[capacity - c] is best[c]
    for c in range(1, capacity + 1):
        s = price[1 : c + 1] + back[capacity - c + 1 :]
        j = s.argmax()
        if s[j] > best[c - 1]:
            best[c], used[c] = s[j], j + 1
        else:
            best[c] = best[c - 1]
        back[capacity - c] = best[c]
    return best, used


def _read(used: np.ndarray, room: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while room > 0:
        n = int(used[room])
        if n:
            found[n] = found.get(n, 0) + 1
        room -= n or 1
    return found


def solve(counts: np.ndarray, capacity: int) -> tuple[dict[Config, float], np.ndarray, np.ndarray, float]:
    """Multiplicative weights: (configurations with their multiples, coverage of each length, prices, lower bound of sequences)."""
    rows = np.flatnonzero(counts)
    log_price = np.log(np.maximum(np.arange(capacity + 1), 1) / capacity)
    bound, prices, taken, cover = 0.0, np.zeros(capacity + 1), {}, np.zeros(capacity + 1)
    for rate, part, rounds in STAGES:
        cover, taken, mean = np.zeros(capacity + 1), {}, np.zeros(capacity + 1)
        for step in range(STEPS + 1):
            price = np.zeros(capacity + 1)
            price[rows] = np.exp(log_price[rows] - log_price[rows].max()) if step < STEPS else mean[rows]  # the mean of all steps is priced last
            best, used = knapsack(price, capacity)
            price /= best[capacity]
            mean += price
            if price @ counts > bound:
                bound, prices = float(price @ counts), price
            if step == STEPS or cover[rows].min() >= rounds:
                break
            value = price[rows] + best[capacity - rows] / best[capacity]
            order = np.argsort(-value, kind="stable")[:COLUMNS]
            gain = np.zeros(capacity + 1)
            found = {}
            for n in rows[order[value[order] >= NEAR]]:
                config = _read(used, capacity - int(n))
                config[int(n)] = config.get(int(n), 0) + 1
                found[tuple(sorted(config.items()))] = None
            for config in found:
                amount = part * min(counts[n] / k for n, k in config)
                taken[config] = taken.get(config, 0.0) + amount
                for n, k in config:
                    gain[n] += k * amount / counts[n]
            cover += gain
            log_price -= rate * gain
    return taken, cover, prices, bound


def _kept(taken: dict[Config, float], counts: np.ndarray, scale: float) -> tuple[list[tuple[int, Config]], np.ndarray]:
    """Whole multiples of the solution, and what is left of the counts."""
    left, out = counts.copy(), []
    for config, amount in sorted(taken.items(), key=lambda x: (-x[1], x[0])):
        times = min(int(amount / scale + 1e-9), *(int(left[n]) // k for n, k in config))
        if times > 0:
            out.append((times, config))
            for n, k in config:
                left[n] -= times * k
    return out, left


def _filled(left: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[int, Config]]:
    """Sequences for all that is left: the longest opens one, a knapsack at these prices completes it."""
    left, size = left.copy(), np.arange(capacity + 1)
    price = (prices + 1e-9 * size) * (1 + 0.05 * size / capacity)  # of equal fillings the one of longer documents, short ones fit later too
    out, used, longest = [], None, capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        config, room, without = {longest: 1}, capacity - longest, set()
        while room > 0:
            if used is None or without:
                now = np.where(left > 0, price, 0)
                now[list(without)] = 0
                reach = room if without else capacity - longest
                _, used = knapsack(now[: reach + 1], reach)
            found, clipped = _read(used, room), False
            for n, k in found.items():
                here = min(k, int(left[n]) - config.get(n, 0))
                if here < k:
                    clipped = True
                    without.add(n)
                if here:
                    config[n] = config.get(n, 0) + here
                    room -= here * n
            if without:
                used = None
            if not clipped:
                break
        times = min(int(left[n]) // k for n, k in config.items())
        out.append((times, tuple(sorted(config.items()))))
        for n, k in config.items():
            left[n] -= times * k
            if not left[n]:
                used = None


def plan(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, Config]], float]:
    """Configurations with whole multiples that hold exactly ``counts`` (by length, 0 to capacity), and a lower bound of sequences."""
    counts = counts.astype(np.int64)
    full = int(counts[capacity])
    short = counts.copy()
    short[capacity] = 0
    out: list[tuple[int, Config]] = [(full, ((capacity, 1),))] if full else []
    if not short.any():
        return out, float(full)
    taken, cover, prices, bound = solve(short, capacity)
    found = []
    for scale in SCALES:
        part = np.inf if scale is None else max(1.0, float(np.quantile(cover[short > 0], scale)))
        kept, left = _kept(taken, short, part)
        found.append(kept + _filled(left, prices, capacity))
    return out + min(found, key=lambda p: sum(times for times, _ in p)), full + bound


class Places:
    """For the r-th document of a length: its sequence and its place there."""

    def __init__(self, configs: list[tuple[int, Config]]):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for times, config in configs:
            offset = 0
            for n, k in config:
                at = taken.get(n, 0)
                by.setdefault(n, []).append((at, k, first, offset))
                taken[n] = at + times * k
                offset += n * k
            first += times
        self.sequences, self._by = first, {n: np.array(rows, dtype=np.int64).T for n, rows in by.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for n in np.unique(length):
            here = length == n
            starts, times, first, place = self._by[int(n)]
            r = rank[here]
            i = np.searchsorted(starts, r, side="right") - 1
            copy, nth = np.divmod(r - starts[i], times[i])
            sequence[here], offset[here] = first[i] + copy, place[i] + nth * n
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row for each piece, numbered among the pieces of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches):
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(tokenizer, text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, (at, to) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    raw = ids[at:to].tobytes()
                    rows.append((name, k, at, to - at, zlib.crc32(raw), part, int(seen[to - at]), raw if with_ids else None))
                    seen[to - at] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, f"{id_col} long, piece int, start long, length long, ids_crc32 long, part long, nth long, ids binary")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence; with ``with_ids`` its ids too (uint32, little endian)."""
    rows = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    rows = written(rows if with_ids else rows.drop("ids"), "pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("length", "part").count()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in held.groupBy("length").agg(F.sum("count").alias("n")).toLocalIterator():  # a row for each length, capacity at most
        histogram[r.length] = r.n
    places = Places(plan(histogram, capacity)[0])
    bases = held.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    out = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = rows.join(bases, ["length", "part"]).select(*out, (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places(b.column(3).to_numpy(), b.column(len(out)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*out, "sequence_id", "offset"])

    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long{', ids binary' if with_ids else ''}, sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)
