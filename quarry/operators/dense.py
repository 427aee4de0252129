"""Dense vectors: metrics, blocked exact search, radius, groups, IVF and quantised search."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType


#: Rows that are compared with all centres at a time.
FILED = 1_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better for all: distances come negated."""
    if metric == "l2":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0))
    if metric == "cosine":
        q, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (q, v))
    return q @ v.T


def stored_as(rows: DataFrame, vector_col: str) -> type:
    """How a block stores components: vectors of 8 or 32 bits stay so on their way."""
    return {ByteType: np.int8, FloatType: np.float32}.get(type(rows.schema[vector_col].dataType.elementType), np.float64)


def best_of(s: np.ndarray, ids: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k best finite scores of each row, by score, then id; only what reaches a row's k-th is sorted."""
    s = np.where(np.isfinite(s), s, -np.inf)
    if k is None or k >= s.shape[1]:
        return np.nonzero(s > -np.inf)
    row, col = np.nonzero((s >= np.partition(s, -k, axis=1)[:, -k, None]) & (s > -np.inf))
    order = np.lexsort([ids[col], -s[row, col], row])
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept]


def _blocks(rows: DataFrame, id_col: str, vector_col: str, keys: list[str], per: int, dealt: bool = False) -> DataFrame:
    """Packs rows into blocks of at most ``per``: ids, their common keys and a matrix in one row each.

    No shuffle, unless ``dealt``: then rows of a key come together first, so that a key with few
    rows in each of many partitions still makes few blocks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            width = f[vector_col].map(len)
            tag = pd.Series([json.dumps(list(t)) for t in f[keys].itertuples(index=False)] if keys else "", index=f.index)
            for (of, _), same in f.groupby([tag, width], sort=False):
                for at in range(0, len(same), per):
                    part = same.iloc[at : at + per]
                    x = np.array(part[vector_col].tolist(), dtype)
                    yield pd.DataFrame({"ids": [part[id_col].tolist()], "tag": [of], "m": [x.tobytes()], "n": [len(part)]})

    dtype = stored_as(rows, vector_col)
    named = [F.col(c).cast("string").alias(f"_key{i}") for i, c in enumerate(keys)]
    keys = [f"_key{i}" for i in range(len(keys))]
    rows = rows.where(F.size(vector_col) > 0).select(id_col, vector_col, *named)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys) if dealt else rows
    return rows.mapInPandas(run, "ids array<long>, tag string, m binary, n int")


def search(
    vectors: DataFrame, queries: DataFrame, k: int | None = 10, metric: str = "cosine", least: float | None = None, same: tuple[str, ...] = (),
    id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding", digits: int = 6, per: int = 2048, group_col: str | None = None, dealt: bool = False, ranked: bool = True,
) -> DataFrame:
    """Exact search of a stated query set against all vectors, in blocks.

    A block of queries meets a block of vectors in one matrix product and sends on
    only its own k best of each query (or those of at least ``least``), so nothing
    of the size of their product is ever stored. ``same`` asks for equal columns:
    blocks hold one value each and only those of equal values meet. With ``group_col``
    the k best of each query and each value of that column (null is one) are found,
    and the column comes too. Vectors of another length than the query's are not met.
    Where ``same`` has many values, ``dealt`` brings the rows of each together before they are
    packed; without ``ranked`` the best of every block come as they are.
    """
    for c in same:  # a null equals nothing
        queries, vectors = queries.where(F.col(c).isNotNull()), vectors.where(F.col(c).isNotNull())
    q = _blocks(queries, query_col, vector_col, list(same), per, dealt).toDF("q_ids", "q_tag", "q", "q_n")
    v = _blocks(vectors, id_col, vector_col, [group_col] if group_col else list(same), per, dealt)
    q_type, v_type = stored_as(queries, vector_col), stored_as(vectors, vector_col)
    met = v.join(q, F.col("tag") == F.col("q_tag")) if same else v.crossJoin(q)  # blocks, not rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                a, b = np.frombuffer(r.q, q_type).reshape(r.q_n, -1), np.frombuffer(r.m, v_type).reshape(r.n, -1)
                a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
                if a.shape[1] != b.shape[1]:
                    continue
                s = np.round(_scores(a, b, metric), digits) + 0.0
                if least is not None:
                    s[s < least] = -np.inf
                ids, qid = np.array(r.ids), np.array(r.q_ids)
                row, col = best_of(s, ids, k)
                yield pd.DataFrame({query_col: qid[row], id_col: ids[col], "score": s[row, col], "tag": r.tag})

    met = met.mapInPandas(run, f"{query_col} long, {id_col} long, score double, tag string")
    if group_col:
        met = met.withColumn(group_col, F.get(F.from_json("tag", "array<string>"), F.lit(0)).cast(vectors.schema[group_col].dataType))
    met = met.drop("tag")
    if k is None or not ranked:
        return met
    w = Window.partitionBy(query_col, *([group_col] if group_col else [])).orderBy(F.desc("score"), F.asc(id_col))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_top(hits: DataFrame, group_col: str, per_group: int, groups: int, query_col: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """The best ``per_group`` hits of the ``groups`` best groups of each query."""
    inner = Window.partitionBy(query_col, group_col).orderBy(F.desc("score"), F.asc(id_col))
    ranked = hits.withColumn("in_group", F.row_number().over(inner)).where(F.col("in_group") <= per_group)
    best = ranked.where("in_group = 1").select(query_col, group_col, F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(group_col))).alias("group_rank"))
    return ranked.join(best.where(F.col("group_rank") <= groups), [query_col, group_col])


class Ivf:
    """An inverted file: k-means centres fitted on a bounded sample, every row filed under its nearest.

    The number of lists is the square root of the number of rows unless given, so lists stay of
    a size that grows slowly; the sample has four rows for each list, ``sample_rows`` at least.
    ``probes`` is the least number of lists that finds ``recall`` of the ten nearest on the
    sample, by exact search there.
    """

    def __init__(
        self, vectors: DataFrame, lists: int | None = None, sample_rows: int = 20_000, rounds: int = 12, seed: int = 5, recall: float = 0.97,
        id_col: str = "vec_id", vector_col: str = "embedding",
    ):
        self.id_col, self.vector_col = id_col, vector_col
        lists = lists or max(1, int(vectors.count() ** 0.5))
        sample_rows = max(sample_rows, 4 * lists)
        some = vectors.where(F.size(vector_col) > 0).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(vector_col).toPandas()
        x = np.array(some[vector_col].tolist(), np.float64) if len(some) else np.zeros((0, 1))  # an empty table has no centres
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        self.centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
        for _ in range(rounds if len(x) else 0):
            near = (x @ self.centres.T).argmax(axis=1)
            for c in range(len(self.centres)):
                if (near == c).any():
                    m = x[near == c].sum(axis=0)
                    self.centres[c] = m / max(np.linalg.norm(m), 1e-300)
        self.probes = self._measured(x, recall)
        self.rows = self.filed(vectors, 1)

    def _measured(self, x: np.ndarray, recall: float, asked: int = 200, k: int = 10) -> int:
        """The least number of lists that holds ``recall`` of the nearest rows of some of the sample."""
        if not len(x):
            return 1
        home, q = (x @ self.centres.T).argmax(axis=1), x[:asked]
        nearest = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
        order = np.argsort(np.argsort(-(q @ self.centres.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(order, home[nearest], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def filed(self, rows: DataFrame, lists: int) -> DataFrame:
        """Rows with ``list_id``, one for each of their nearest lists."""
        centres = self.centres

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(v), FILED):
                x = np.array(v.iloc[at : at + FILED].tolist(), np.float64)
                out += np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :lists].tolist()
            return pd.Series(out)

        return rows.where(F.size(self.vector_col) > 0).withColumn("list_id", F.explode(near(self.vector_col)))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, query_col: str = "query_id") -> DataFrame:
        """Each query looks into its nearest lists only: blocks of one list meet blocks of the queries that ask for it."""
        q = self.filed(queries.select(query_col, self.vector_col), probes or self.probes)
        return search(self.rows, q, k, same=("list_id",), id_col=self.id_col, query_col=query_col, vector_col=self.vector_col, dealt=True)


def quantise(vector: Column) -> Column:
    """Components scaled to the largest and rounded to 8 bits."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.transform(vector, lambda x: F.round(x.cast("double") / top.cast("double") * 127).cast("tinyint"))


def quantised_search(vectors: DataFrame, queries: DataFrame, k: int = 10, refine: int = 4, id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """Candidates (``refine`` times k) by 8-bit vectors, ranked again by the exact ones."""
    small = vectors.withColumn(vector_col, quantise(F.col(vector_col)))
    first = search(small, queries, k * refine, "cosine", id_col=id_col, query_col=query_col, vector_col=vector_col).select(query_col, id_col)
    both = first.join(vectors.select(id_col, vector_col), id_col).join(queries.select(query_col, F.col(vector_col).alias("q")), query_col)
    scored = both.select(query_col, id_col, F.round(cosine(F.col(vector_col), F.col("q")), 6).alias("score"))
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
