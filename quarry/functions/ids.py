"""Identities: UUIDv5 of points, digests, keyed hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """UUID version 5 of a name, in JVM expressions only."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(project: Column, file: Column, start_line: Column, part: Column | None = None) -> Column:
    """The id of a chunk; parts after the first of one line carry their number, so they don't overwrite each other."""
    seed = F.concat_ws(":", project, file, start_line.cast("string"))
    if part is not None:
        seed = F.when(part > 0, F.concat_ws(":", seed, part.cast("string"))).otherwise(seed)
    return uuid5(seed)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def collection_name(project: Column, domain: Column, model: Column, dim: Column, backend: Column) -> Column:
    return F.concat_ws("_", project, domain, model, dim.cast("string"), backend)


def fnv1a(values: pa.Array, start: int, prime: int) -> np.ndarray:
    """FNV-1a of the bytes of every value (empty for null) in 64-bit arithmetic, one place of all values at a time."""
    raw = values.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data, at, length = np.frombuffer(raw.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)
    h, left = np.full(len(raw), start, np.uint64), np.flatnonzero(length)
    j = 0
    while len(left):
        h[left] = (h[left] ^ data[at[left] + j]) * np.uint64(prime)
        j += 1
        left = left[length[left] > j]
    return h


def fnv64(text: Column) -> Column:
    """FNV-1a of 64 bits as hex. The product wraps around, which SQL arithmetic doesn't, so it runs in numpy on Arrow batches."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        h = fnv1a(v, 0xCBF29CE484222325, 0x100000001B3)
        return pa.array([f"{x:016x}" for x in h.tolist()], pa.string(), mask=v.is_null().to_numpy(zero_copy_only=False))

    return run(text)


def fnv32_mod(text: Column, modulus: int) -> Column:
    """FNV-1a of 32 bits modulo ``modulus``: the low half of the 64-bit product is that of the 32-bit one."""

    @F.arrow_udf("int")
    def run(v: pa.Array) -> pa.Array:
        h = (fnv1a(v, 2166136261, 16777619) & np.uint64(0xFFFFFFFF)) % np.uint64(modulus)
        return pa.array(h.astype(np.int32), mask=v.is_null().to_numpy(zero_copy_only=False))

    return run(text)


def keyed_hash(text: Column, key: str) -> Column:
    """HMAC-SHA256 as hex: the inner and outer pads are constants, so it stays in the JVM."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in raw).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
