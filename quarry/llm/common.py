"""Helpers shared by the corpus operators.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` without an
argument cuts at exactly those six bytes, so it is used throughout.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regex of white space between words.
SPACE = r"[\x20\x09-\x0D]+"

_M = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, parts: int, rest: int) -> Column:
    """True where crc32(id as text) mod ``parts`` is ``rest``; a null id is in no such fold."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % parts == rest, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in local mode (tests) a temporary folder is set; on a
    cluster executors would write to their own disks, so that is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return where


#: Where set, Spark removes an execution's shuffle files as it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str) -> None:
    """Writes ``df`` as Parquet; the shuffle files behind it go, for its readers read the table."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    This cuts lineage with files that outlive any executor. The files go when
    the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    save(df, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for a job's many tables, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of ``scratch`` that no reader needs any more, before the driver's process ends."""
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already at exit
        pass


def bounded_ids(docs: DataFrame, chosen: DataFrame, most_rows: int, id_col: str, most_copies: int = 100) -> DataFrame:
    """Of ``chosen`` (a bounded table of ids) those, by hash, that name at most ``most_rows`` rows of ``docs``; ids of more than ``most_copies`` rows are left out."""
    held = docs.select(id_col).join(F.broadcast(chosen.select(id_col)), id_col).groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col("_n") <= most_copies)
    so_far = F.sum("_n").over(Window.orderBy(F.xxhash64(id_col), id_col).rowsBetween(Window.unboundedPreceding, 0))
    return chosen.join(held.withColumn("_n", so_far).where(F.col("_n") <= most_rows).select(id_col), id_col)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most ``rows`` rows and about ``size`` bytes (one row at least)."""
    for batch in batches:
        at = 0
        n = batch.num_rows
        each = max(1, int(size / max(1, batch.nbytes / max(1, n))))
        step = min(rows, each)
        while at < n:
            yield batch.slice(at, step)
            at += step


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with an explicit schema string."""
    return df.mapInArrow(fn, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit integers (multiply and xor-shift), bijective."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHash:
    """64-bit hashes of words, remembered in a table of bounded size."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        import xxhash

        self._hash, self._seed, self._most, self._table = xxhash.xxh3_64_intdigest, seed, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get, h, seed = self._table.get, self._hash, self._seed
        out = [get(w) for w in words]
        if None in out:
            t = self._table
            if len(t) > self._most:
                t.clear()
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    x = t.get(w)
                    if x is None:
                        x = t[w] = h(w, seed)
                    out[i] = x
        return np.array(out, dtype=np.uint64)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
