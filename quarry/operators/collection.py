"""A collection of points as a DataFrame: writes, lookups, browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(points: DataFrame, fresh: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """New rows replace those of the same key; only fresh keys are looked for, the rest isn't sorted.

    A key that comes several times leaves one row: the last by ``seq``, or any where no order is given.
    """
    fresh = latest(fresh, key, [F.desc(seq)]).select(*points.columns) if seq else fresh.dropDuplicates([key])
    return points.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def written(points: DataFrame, fresh: DataFrame, valid: Column | None = None, key: str = "id", seq: str | None = None) -> DataFrame:
    """``fresh`` with ``outcome``, what ``upsert`` makes of each row: inserted, updated, superseded (by a later row of its key, by ``seq``) or rejected (no key, or not ``valid``). One join."""
    sound = F.col(key).isNotNull() & (F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True))
    rows = fresh.withColumn("_sound", sound)
    if seq:
        later = Window.partitionBy(key, "_sound").orderBy(F.desc(seq))
        rows = rows.withColumn("_last", F.row_number().over(later) == 1)
    else:
        rows = rows.withColumn("_last", F.lit(True))
    held = points.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    joined = rows.join(held, rows[key] == held["_key"], "left")
    outcome = F.when(~F.col("_sound"), "rejected").when(~F.col("_last"), "superseded").when(F.col("_key").isNull(), "inserted").otherwise("updated")
    return joined.select(*fresh.columns, outcome.alias("outcome"))


def update(points: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns that a change gives replace the old ones; null keeps them; unknown keys are left out."""
    given = [c for c in changes.columns if c != key]
    joined = points.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in given]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in points.columns])


def delete_ids(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def delete_files(points: DataFrame, files: DataFrame, key: str = "source_file") -> DataFrame:
    return points.join(files.select(key).distinct(), key, "left_anti")


def replace_files(points: DataFrame, fresh: DataFrame, file_col: str = "source_file") -> DataFrame:
    """All points of a changed file go before its new ones come."""
    return delete_files(points, fresh, file_col).unionByName(fresh)


def apply_changes(points: DataFrame, feed: DataFrame, key: str = "id", op: str = "op", seq: str = "seq") -> DataFrame:
    """A change feed: the last operation of each key counts; ``delete`` removes."""
    last = latest(feed, key, [F.desc(seq)])
    kept = last.where(F.col(op) != "delete").select(*points.columns)
    return points.join(last.select(key), key, "left_anti").unionByName(kept)


def facets(points: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of non-empty values, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
    return points.select(pairs).select("f.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def row_order(by_score: bool = False, score: str = "score", file: str = "source_file", line: str = "start_line", key: str = "id") -> list[Column]:
    """The order of a browser's rows: by score if asked for, then file and line, then key."""
    return [*([F.desc(score)] if by_score else []), F.asc(file), F.asc(line), F.asc(key)]


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page by position; numbers under 1 mean the first; past the end it is empty."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = 25) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def scroll(points: DataFrame, after: object = None, limit: int = 50, key: str = "id") -> DataFrame:
    """The next rows after a key: limit 50 if not positive, at most 500."""
    limit = 50 if limit <= 0 else min(500, limit)
    rows = points if after is None else points.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def info(points: DataFrame, vector_col: str) -> DataFrame:
    return points.agg(F.count("*").alias("points"), F.max(F.size(vector_col)).alias("vector_size"))


def upload_batches(docs: DataFrame, group_col: str, key: str, size: int = 64) -> DataFrame:
    """Numbers batches of at most ``size`` rows within each group, by key.

    Rows are dealt by ranges of (group, key), so a group of any size is spread; each is numbered
    within its range, and a range's rows go after those of the ranges before it.
    """
    place = evaluate.placed(docs, [group_col], [key])
    return place.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def points_per_file(points: DataFrame, file_col: str = "source_file") -> DataFrame:
    """(file, points): how many points each file has."""
    return points.groupBy(file_col).agg(F.count("*").alias("points"))


def chunk_rows(points: DataFrame) -> DataFrame:
    """Points as rows of a browser: empty names shown as such, line numbers from text (0 where they are none), sizes in bytes."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)")).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0)).alias(c)
    return points.select("id", shown("source_file"), shown("language"), shown("symbol"), "name", number("start_line"), number("end_line"), F.octet_length("content").alias("size"))


def hits_where(hits: DataFrame, points: DataFrame, condition: Column, key: str = "id") -> DataFrame:
    """Hits of a search whose points meet a condition, with their columns; which side travels is the planner's choice by size, for hits may outnumber points."""
    return points.where(condition).join(hits, key)


def seeded(rows: DataFrame, seed: DataFrame) -> DataFrame:
    """The rows, or the seed where there are none."""
    empty = rows.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return rows.unionByName(seed.crossJoin(F.broadcast(empty)).where("_empty").drop("_empty"))
