"""Snapshots of files: differences, what to read again, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, change): added, modified, deleted or unchanged."""
    a = now.select(key, F.col(digest).alias("_now"), F.lit(1).alias("_a"))
    b = before.select(key, F.col(digest).alias("_before"), F.lit(1).alias("_b"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.col("_now").eqNullSafe(F.col("_before")), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def changed(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Files to read: new ones and those with another digest."""
    old = before.select(key, F.col(digest).alias("_before"))
    return now.join(old, key, "left").where(~F.col(digest).eqNullSafe(F.col("_before"))).drop("_before")


def stale(stored: DataFrame, walked: DataFrame, key: str = "path") -> DataFrame:
    """Stored files that the walk no longer meets."""
    return stored.join(walked.select(key), key, "left_anti")


def apply(before: DataFrame, now: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The snapshot after ``files`` were handled: their entries as they are now, absent ones gone."""
    handled = files.select(key).distinct()
    return before.join(handled, key, "left_anti").unionByName(now.join(handled, key, "left_semi"))


def plan(differences: DataFrame, points: int | Column, async_files: int = 200, sync_changes: int = 50, group: list[str] | None = None) -> DataFrame:
    """One row: counts and ``mode`` (none, delta or full; ``sync`` or not).

    Full where the store is empty (``points`` is 0; a column tells it for each group) or over half of the files changed.
    """
    n = lambda what: F.count(F.when(F.col("change") == what, 1))
    counts = differences.groupBy(*(group or [])).agg(n("added").alias("added"), n("modified").alias("modified"), n("deleted").alias("deleted"), n("unchanged").alias("unchanged"))
    total, change = F.col("added") + F.col("modified") + F.col("unchanged"), F.col("added") + F.col("modified") + F.col("deleted")
    mode = F.when(F.lit(points) == 0, "full").when(change == 0, "none").when(change * 2 > total, "full").otherwise("delta")
    return counts.withColumns({"changes": change, "mode": mode}).withColumn("sync", F.when(F.col("mode") == "full", total <= async_files).otherwise(F.col("changes") <= sync_changes))
