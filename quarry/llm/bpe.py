"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes before a white-space run decides where a text is cut,
so equal passages are cut alike wherever they stand. Every chunk is asked for in the
chunk table first; those that no document of this worker has had are encoded by the
library, in one batch for many texts (Latin ones past the normalizer, see ``lowered``). The table holds a bounded number of bytes, is
shared by all tasks of a worker, and only saves time: an emptied table changes no id.

Joins are then repaired. At each join the last piece of the chunk before and the first
of the chunk behind are encoded together by the library, once for each two such pieces:
the ids must be those that stand on both sides of the join. Where they aren't, the
chunk is joined with the one before it and encoded again, widening to the left until
the library's ids for both together are those of each alone.

Null: empty. Empty: no ids. Very long texts: by chunks, and a text without white space
is one chunk. An empty table gives no rows. Bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8
from .tokens import library, lowered, unnormalized

#: White space of one byte, as a table over bytes.
_BLANK = np.isin(np.arange(256), list(b" \t\n\r"))
_WINDOW = 8

Cut = list[tuple[bytes, bytes, bool]]  # of a text, its chunks: bytes, ids, does the join before it agree


def cuts(data: np.ndarray, starts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins of all white-space runs within the texts of ``data``, and which of them are cut: by the bytes before alone."""
    blank = _BLANK[data]
    runs = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    far = runs - starts[np.searchsorted(starts, runs, side="right") - 1]
    runs, far = runs[far > 0], far[far > 0]
    h = np.zeros(len(runs), np.uint32)
    for j in range(_WINDOW, 0, -1):
        h = h * np.uint32(31) + data[np.maximum(runs - j, 0)]
    return runs, (far >= _WINDOW) & ((h * np.uint32(2654435761) >> np.uint32(16)) & np.uint32(mask) == 0)


class ChunkCoder:
    """Encodes texts with one tokenizer file, reusing chunks."""

    def __init__(self, path: str, mask: int = 31, most_bytes: int = 64_000_000, most_joins: int = 500_000):
        self.lib, self.plain = library(path), unnormalized(path)
        self.mask, self.most_bytes, self.most_joins = mask, most_bytes, most_joins
        self.chunks: dict[bytes, bytes] = {}  # a chunk's digest: its ids
        self.joins: dict[tuple[bytes, bytes], bool] = {}  # pieces on both sides: do they agree
        self.held = self.reused = self.fresh = 0

    def _encode(self, text: bytes) -> bytes:
        return self._batch([text])[0]

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        whole = [t.decode(errors="replace") for t in texts]
        plain = [lowered(t, self.plain[1]) for t in whole] if self.plain else [None] * len(whole)
        found: dict[bool, Iterator] = {}
        for low in (True, False):
            some = [p if low else t for t, p in zip(whole, plain, strict=True) if (p is not None) == low]
            found[low] = iter((self.plain[0] if low else self.lib).encode_batch_fast(some, add_special_tokens=False) if some else ())
        return [np.array(next(found[p is not None]).ids, dtype="<u4").tobytes() for p in plain]

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks, from the table or, all missing ones in one batch, from the library."""
        import xxhash

        keys = [xxhash.xxh3_128_digest(c) for c in chunks]
        got = [self.chunks.get(k) for k in keys]
        new = {k: c for k, c, g in zip(keys, chunks, got, strict=True) if g is None}
        if not new:
            self.reused += len(chunks)
            return got
        if self.held > self.most_bytes:
            self.chunks.clear()
            self.held = 0
        made = dict(zip(new, self._batch(list(new.values())), strict=True))
        self.chunks.update(made)
        self.held += sum(map(len, made.values())) + 100 * len(made)
        self.fresh += len(made)
        self.reused += len(chunks) - len(made)
        return [made[k] if g is None else g for k, g in zip(keys, got, strict=True)]

    def learn(self, texts: list[bytes | str]) -> list[Cut]:
        """Cuts texts into chunks, encodes those never met, and holds every join against the library."""
        raw = [t.encode() if isinstance(t, str) else t for t in texts]
        data = b"".join(raw)
        sizes = np.array([len(t) for t in raw], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        full = np.flatnonzero(sizes)
        if not len(full):
            return [[] for _ in raw]
        runs, cut = cuts(np.frombuffer(data, np.uint8), starts[full], self.mask)
        chosen = np.flatnonzero(cut)
        at = runs[chosen]
        bounds = np.sort(np.concatenate([at, ends[full]])).tolist()
        begins = np.sort(np.concatenate([at, starts[full]])).tolist()
        chunks = [data[a:b] for a, b in zip(begins, bounds, strict=True)]
        ids = self._known(chunks)
        # the pieces on both sides of each cut, within its text
        text = full[np.searchsorted(starts[full], at, side="right") - 1]
        before = np.maximum(starts[text], np.where(chosen > 0, runs[np.maximum(chosen - 1, 0)], 0))
        after = np.minimum(ends[text], np.where(chosen + 1 < len(runs), runs[np.minimum(chosen + 1, len(runs) - 1)], len(data)))
        sides = [(data[a:b], data[b:c]) for a, b, c in zip(before.tolist(), at.tolist(), after.tolist(), strict=True)]
        second = np.searchsorted(begins, at).tolist()
        self._check(sides, [(ids[k - 1], ids[k]) for k in second])
        agreed = [True] * len(chunks)
        for k, side in zip(second, sides, strict=True):
            agreed[k] = self.joins[side]
        first = np.searchsorted(begins, starts[full]).tolist()
        out: list[Cut] = [[] for _ in raw]
        for t, a, b in zip(full.tolist(), first, [*first[1:], len(chunks)], strict=True):
            out[t] = list(zip(chunks[a:b], ids[a:b], agreed[a:b], strict=True))
        return out

    def _check(self, sides: list[tuple[bytes, bytes]], ids: list[tuple[bytes, bytes]]) -> None:
        """For pieces that never met: whether the library's ids of both are those at the end of one chunk and the beginning of the next."""
        if len(self.joins) > self.most_joins:
            self.joins.clear()
        new = {s: i for s, i in zip(sides, ids, strict=True) if s not in self.joins}
        for (side, (left, right)), both in zip(new.items(), self._batch([a + b for a, b in new]), strict=True):
            self.joins[side] = any(left.endswith(both[:k]) and right.startswith(both[k:]) for k in range(0, len(both) + 4, 4))

    def encode(self, cut: Cut) -> bytes:
        """The ids of a text from its chunks."""
        if all(agrees for _, _, agrees in cut):
            return b"".join(ids for _, ids, _ in cut)
        groups: list[tuple[bytes, bytes]] = []  # text and ids; the joins between groups agree
        for text, ids, agrees in cut:
            if not agrees:
                while groups and self._encode(groups[-1][0] + text) != groups[-1][1] + ids:
                    text = groups.pop()[0] + text  # noqa: PLW2901
                    ids = self._encode(text)  # noqa: PLW2901
            groups.append((text, ids))
        return b"".join(g for _, g in groups)


@lru_cache(2)
def coder(path: str) -> ChunkCoder:
    """One table for all tasks of a worker."""
    return ChunkCoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Ids (uint32, little endian) and decoded text of each document; with ``digest`` their SHA-256 and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in slices(batches, 500, 4_000_000):
            names = batch.column(0).to_pylist()
            raw = [own.encode(cut) for cut in own.learn(utf8(batch.column(1)))]
            decoded = own.lib.decode_batch([np.frombuffer(r, dtype="<u4").tolist() for r in raw], skip_special_tokens=False)
            counts = pa.array([len(r) // 4 for r in raw], pa.int64())
            if digest:
                sha = lambda items: pa.array([hashlib.sha256(x).hexdigest() for x in items], pa.string())
                out = [sha(raw), sha(d.encode() for d in decoded)]
            else:
                out = [pa.array(raw, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), counts, *out], [id_col, "n_tokens", *cols])

    cols = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, f"{id_col} long, n_tokens long, {kinds}")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows with ids as little-endian uint32; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text_of(raw):  # noqa: ANN001, ANN202
        lib = library(tokenizer)
        return raw.map(lambda r: None if r is None else lib.decode(np.frombuffer(r, dtype="<u4").tolist(), skip_special_tokens=False))

    return encoded.withColumn("decoded", text_of(ids_col))
