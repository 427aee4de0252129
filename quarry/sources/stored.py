"""Tables that outlive the query that made them: bucketed Parquet in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset in local mode a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="stored-")
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that it is made once and its size is known."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that a broadcast may hold.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table, to be broadcast if it has at most ``most`` rows; else left to the join's own choice."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df


def remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already at exit
        pass


def laid_out(df: DataFrame, path: str, order: list[str], named: tuple[str, ...] = (), files: int | None = None, group_bytes: int = 16 << 20) -> DataFrame:
    """Writes ``df`` in files of one range of ``order`` each, sorted, so that their statistics tell ranges apart, and with bloom filters of the columns ``named``.

    A filter on those columns then skips files and row groups that hold no such row.
    """
    rows = df.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    writer = rows.write.option("compression", "zstd").option("parquet.block.size", group_bytes).option("parquet.block.row.count.limit", 100_000)
    for c in named:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, by: str, order: list[str], buckets: int, dealt: bool = False) -> DataFrame:
    """Writes ``df`` in ``buckets`` files by the hash of a column, each in order, and reads it as a table that knows so.

    ``dealt``: its partitions are those of ``repartition(buckets, by)`` already.
    """
    spark = df.sparkSession
    rows = df if dealt else df.repartition(buckets, by).sortWithinPartitions(*order)
    name = f"stored_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, by).sortBy(*order).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def opened(spark: SparkSession, path: str, like: DataFrame, by: str, order: list[str], buckets: int) -> DataFrame:
    """The table in a folder that ``bucketed`` wrote."""
    name = f"stored_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    sorted_by = ", ".join(f"`{c}`" for c in order)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY ({sorted_by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class Pointer:
    """A small state beside versions of tables: read as a whole, replaced by a rename, so readers see the old one or the new."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> dict | None:
        """The state, or None before the first; after a crash between two renames it is the one before."""
        for name in ("current", "previous"):
            if self._fs.exists(self._path(f"{self.folder}/{name}")):
                return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))
        return None

    def replace(self, state: dict) -> None:
        fresh, at, old = (self._path(f"{self.folder}/{x}") for x in ("next", "current", "previous"))
        self._fs.delete(fresh, True)
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(fresh.toString())
        if self._fs.exists(at):
            self._fs.delete(old, True)
            self._fs.rename(at, old)
        if not self._fs.rename(fresh, at):
            raise OSError(f"{at.toString()} can't be replaced")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)
