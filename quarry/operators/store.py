"""An index on disk: one run takes a source tree to stored points, keyword postings and a snapshot.

The store is a folder of versions. A run walks the tree, compares it with the last snapshot,
chunks (and embeds) what changed, and writes the next version beside the last: points, their
postings and the snapshot. Only then the pointer moves, by a rename, so a run that fails or
is killed leaves the last version in force, and readers never see half a run. The pointer names
the run's counts too. Files that can't be read as text (no UTF-8) are indexed with the bad bytes
replaced and counted as ``mended``; blank ones are counted as ``skipped``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, stored
from . import index, postings


@dataclass
class Counts:
    """What a run did: files seen, handled anew, left as they were, gone, skipped and mended; chunks made and points held."""

    files: int = 0
    handled: int = 0
    unchanged: int = 0
    removed: int = 0
    skipped: int = 0
    mended: int = 0
    chunks: int = 0
    points: int = 0


class Store:
    """Versions of an index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pointer = stored.Pointer(spark, self.path)

    @property
    def version(self) -> int:
        """0 before the first run."""
        state = self._pointer.read()
        return state["version"] if state else 0

    @property
    def counts(self) -> Counts | None:
        state = self._pointer.read()
        return Counts(**state["counts"]) if state else None

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.path}/v{version or self.version}/{name}"

    @property
    def points(self) -> DataFrame:
        return self.spark.read.parquet(self._at("points"))

    @property
    def snapshot(self) -> DataFrame:
        return self.spark.read.parquet(self._at("snapshot"))

    @property
    def keywords(self) -> postings.Index:
        return postings.Index.open(self.spark, self._at("keywords"))

    def run(self, root: str, project: str, embed: Callable[[DataFrame], DataFrame] | None = None, **walk: tuple[str, ...]) -> Counts:
        """Brings the store to the state of the tree under ``root``."""
        state = self._pointer.read()
        version = (state["version"] if state else 0) + 1
        self._pointer.drop(f"v{version}")  # of a run that didn't end
        found = files.walk(self.spark, root, **walk)
        found.write.option("compression", "zstd").parquet(self._at("files", version))  # the tree is read once
        tree = self.spark.read.schema(found.schema).parquet(self._at("files", version))
        named = F.lit(project)
        done = index.delta(tree, self.snapshot, self.points, named, embed) if state else index.full(tree, named, embed)
        done.points.write.option("compression", "zstd").parquet(self._at("points", version))
        done.snapshot.write.parquet(self._at("snapshot", version))
        points = self.spark.read.parquet(self._at("points", version))
        postings.Index.build(points, self._at("keywords", version), "id", "content")
        seen = files.walk(self.spark, root, content=False, **walk).count()
        size = tree.agg(F.count("*").alias("files"), F.sum(F.contains("content", F.lit("�")).cast("long")).alias("mended")).first()
        handled = done.handled.count()
        fresh = points.join(done.handled.withColumnRenamed("path", "source_file"), "source_file", "left_semi").count()
        counts = Counts(size.files, handled, size.files - handled, done.removed.count(), seen - size.files, size.mended or 0, fresh, points.count())
        self._pointer.replace({"version": version, "counts": asdict(counts)})
        return counts

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions before the last ``keep``."""
        for v in range(1, self.version - keep + 1):
            self._pointer.drop(f"v{v}")
