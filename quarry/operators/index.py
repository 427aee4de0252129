"""An incremental index run: what changed is chunked and replaces its files' points; the rest stays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import chunk, collection, manifest


@dataclass
class Run:
    """What a run leaves: all points, the new snapshot, the files that were read and those that are gone."""

    points: DataFrame
    snapshot: DataFrame
    handled: DataFrame
    removed: DataFrame


def chunked(files: DataFrame, project: Column, lines: int = chunk.MOST_LINES) -> DataFrame:
    """Points (id, source_file, start_line, end_line, content) of files (path, content); blank chunks are none."""
    rows = chunk.by_lines(files, "path", "content", lines).where(F.trim("content") != "")
    return rows.select(ids.point_id(project, F.col("path"), F.col("start_line")).alias("id"), F.col("path").alias("source_file"), "start_line", "end_line", "content")


def delta(files: DataFrame, before: DataFrame, points: DataFrame, project: Column, embed: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """``files`` (path, content, sha256) against the snapshot ``before`` (path, sha256) and the stored ``points``.

    New and modified files are chunked (and embedded); their old points and those of
    files that are gone go first, so no file keeps points of two states. The content
    of unchanged files is never looked at.
    """
    handled = manifest.changed(files, before)
    removed = manifest.stale(before, files).select("path")
    fresh = chunked(handled, project)
    fresh = embed(fresh) if embed else fresh
    touched = handled.select("path").union(removed).withColumnRenamed("path", "source_file")
    return Run(collection.delete_files(points, touched).unionByName(fresh), files.select("path", "sha256"), handled.select("path"), removed)


def full(files: DataFrame, project: Column, embed: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """All files anew: a delta over an empty snapshot and store."""
    nothing = files.select("path", "sha256").limit(0)
    fresh = chunked(files, project)
    fresh = embed(fresh) if embed else fresh
    return Run(fresh, files.select("path", "sha256"), files.select("path"), nothing.select("path"))
