"""Files of a source tree as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters

FILE_BYTES = 1 << 20


def walk(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """Source files below ``root``: path, size, mtime (and content, sha256).

    Without content the files' bytes are never read: the column is pruned from the scan.
    Files over ``FILE_BYTES`` are left out, as are blank ones. Bytes that are no UTF-8
    are read as U+FFFD; the digest is that of the bytes.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "")
    rows = rows.withColumn("rel", path)
    keep = ~filters.skipped_folder(F.col("rel")) & filters.source_file(F.col("rel")) & filters.pattern_filter(F.col("rel"), include, exclude) & ~filters.ignored(F.col("rel"), ignore)
    rows = rows.where(keep).where(F.col("length") <= FILE_BYTES)
    cols = [F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    if not content:
        return rows.select(*cols)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select(*cols, text.alias("content"), F.sha2("content", 256).alias("sha256")).where(F.col("content").rlike(r"\S"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from JSON: (query_id, text, relevant); both names of the truth column are read."""
    rows = spark.read.schema("id string, query string, relevant array<string>, relevant_files array<string>").option("multiLine", True).json(path)
    return rows.select("id", F.col("query").alias("text"), F.coalesce("relevant", "relevant_files").alias("relevant")).toDF("query_id", "text", "relevant")


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot, or None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def save_points(points: DataFrame, path: str) -> None:
    """Points laid out by collection key, so a query on one collection reads its folders only."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "domain", "model", "dim", "backend").parquet(path)
