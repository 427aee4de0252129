"""Token ids in fixed windows: best-fit-decreasing packing and binary output.

Documents over the window are split into pieces without loss. Pieces are placed,
longest first, into the open window whose room fits best; a segment tree over
room values finds it. Each window is a row of the id matrix with the cumulative
segment lengths and the places where positions start again.

Null, empty: the end id alone. Repeated rows: each is packed. An empty table
gives no rows. A group of ``group_docs`` rows is packed at a time, so memory is
bounded by a group and its longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .tokens import encode


class RoomTree:
    """Counts of open windows by room, as a segment tree: the least room of at least n is found in log steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i, c = room + self.leaves, self.counts
        while i:
            c[i] += by
            i >>= 1

    def least(self, n: int) -> int:
        """The least room >= n that some window has, or -1."""
        i, c = n + self.leaves, self.counts
        if c[i]:
            return n
        while i > 1 and (i & 1 or not c[i + 1]):  # climb until a right sibling holds a window
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.leaves:
            i = 2 * i if c[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` (each at most ``capacity``) in windows."""
    tree, open_by_room, windows = RoomTree(capacity), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room < 0:
            w, room = len(windows), capacity
            windows.append([])
        else:
            w = open_by_room[room].pop()
            tree.add(room, -1)
        windows[w].append(i)
        left = room - sizes[i]
        if left:
            open_by_room.setdefault(left, []).append(w)
            tree.add(left, 1)
    return windows


WINDOW_SCHEMA = "window_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def windows(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    group_docs: int = 4096, group_tokens: int = 4_000_000, dtype: str = "<u4", digest: bool = False,
) -> DataFrame:
    """A row for each window: padded ids (``dtype``), cumulative segment lengths, position resets.

    With ``digest`` the ids come as their SHA-256 (hex) in ``ids_sha256``, padding included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial = TaskContext.get().partitionId() << 40, 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        docs_held = tokens_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, pieces, docs_held, tokens_held
            dealt = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
            for at in range(0, len(dealt), 256):
                rows: list[tuple] = []
                for w in dealt[at : at + 256]:
                    lengths = [len(pieces[i][2]) for i in w]
                    ends = np.cumsum([0, *lengths])
                    row = np.full(capacity, pad_id, dtype=dtype)
                    row[: ends[-1]] = np.concatenate([pieces[i][2] for i in w])
                    raw = row.tobytes()
                    rows.append((first + serial, int(ends[-1]), [pieces[i][0] for i in w], [pieces[i][1] for i in w], ends.tolist(), ends[:-1].tolist(), hashlib.sha256(raw).hexdigest() if digest else raw))
                    serial += 1
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string() if digest else pa.binary())
                names = ["window_id", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "position_resets", "ids_sha256" if digest else "input_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            pieces, docs_held, tokens_held = [], 0, 0

        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(tokenizer, text or ""), np.uint32(end_id))
                pieces += [(name, at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
                docs_held += 1
                tokens_held += len(ids)
                if docs_held >= group_docs or tokens_held >= group_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    schema = WINDOW_SCHEMA.replace("input_ids binary", "ids_sha256 string") if digest else WINDOW_SCHEMA
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, schema)


def write(packed: DataFrame, path: str) -> None:
    """Writes windows as Parquet: the id matrix row by row beside its segment columns."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame, dtype: str = "<u4") -> DataFrame:
    """The documents' pieces back from windows: doc_id, start and ids; concatenated by start they are the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["input_ids"], dtype=dtype)
                for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                    rows.append((d, s, ids[a:b].astype("<u4").tobytes()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["doc_id", "start", "ids"])

    return packed.select("doc_ids", "doc_starts", "cu_seqlens", "input_ids").mapInArrow(run, "doc_id long, start long, ids binary")
