"""Vector indexes beyond the exact scan: stored lists with radii, inner products through distances, product codes.

``Lists`` files every row under its nearest centre and stores it with its distance. A list's
radius, the largest of them, bounds what the list can hold: by the triangle inequality a row
within r of a query is in no list whose centre is farther than r plus the radius. So a radius
search loses nothing, and a top-k search may stop at the lists that could still hold better.

``Codes`` keeps four bits for each pair of components: the nearest of 16 centres fitted on a
bounded sample. Scores of candidates are sums of table entries, looked up by code, and the
best are ranked again by the stored vectors.

Null and empty vectors are filed nowhere. Rows of another length than the index's are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from . import dense

#: Rows of the sample that centres and codebooks are fitted on, and a query set that may be held by every task.
SAMPLE, MOST_QUERIES = 20_000, 100_000


def sample(vectors: DataFrame, rows: int, id_col: str, vector_col: str) -> np.ndarray:
    """The vectors of least id hash, of the table's most common length."""
    sized = vectors.where(F.size(vector_col) > 0)
    usual = sized.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return np.zeros((0, 1))
    some = sized.where(F.size(vector_col) == usual.n).select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(rows).toPandas()
    return np.array(some[vector_col].tolist(), np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centres by Euclidean distance."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds if len(x) else 0):
        near = distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        for j in range(x.shape[1]):
            sums = np.bincount(near, weights=x[:, j], minlength=len(centres))
            centres[:, j] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, j])
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Lists:
    """Stored lists of unit vectors: ``rows`` (id, vector, list_id, away), ``radii`` (list_id, n, radius)."""

    rows: DataFrame
    radii: dict[int, tuple[int, float]]
    centres: np.ndarray
    id_col: str
    vector_col: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", buckets: int | None = None) -> Lists:
        """Lists are as many as the square root of the rows; so are, times four, the rows they are fitted on, where that exceeds ``SAMPLE``."""
        spark = vectors.sparkSession
        lists = lists or max(1, int(vectors.count() ** 0.5))
        x = unit(sample(vectors, max(SAMPLE, 4 * lists), id_col, vector_col))
        centres = kmeans(x, lists)
        width = centres.shape[1]
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

        @F.pandas_udf("struct<list_id: int, away: double>")
        def near(v: pd.Series) -> pd.DataFrame:
            d = distances(unit(np.array(v.tolist(), np.float64)), centres)
            return pd.DataFrame({"list_id": d.argmin(axis=1).astype(np.int32), "away": d.min(axis=1)})

        rows = vectors.where(F.size(vector_col) == width).select(id_col, vector_col, near(vector_col).alias("at")) if len(x) else vectors.limit(0).select(id_col, vector_col, F.struct(F.lit(0).alias("list_id"), F.lit(0.0).alias("away")).alias("at"))
        rows = stored.bucketed(rows.select(id_col, vector_col, "at.list_id", "at.away"), f"{path}/lists", "list_id", ["list_id", id_col], buckets)
        held = rows.groupBy("list_id").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row for each list
        return cls(rows, {r.list_id: (r.n, r.radius) for r in held}, centres, id_col, vector_col)

    def _asked(self, queries: DataFrame, reach: float, query_col: str) -> DataFrame:
        """Queries with each list that may hold a row within ``reach`` of them."""
        known = np.array(sorted(self.radii), dtype=np.int64)
        centres, radius = self.centres[known], np.array([self.radii[c][1] for c in known.tolist()])

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            if not len(known):
                return pd.Series([[] for _ in v])
            d = distances(unit(np.array(v.tolist(), np.float64)), centres)
            return pd.Series([known[row].tolist() for row in d <= reach + radius + 1e-9])

        of_width = queries.where(F.size(self.vector_col) == self.centres.shape[1])
        return of_width.select(query_col, self.vector_col, F.explode(near(self.vector_col)).alias("list_id"))

    def nearest(self, rows: DataFrame, lists: int) -> DataFrame:
        """Rows with ``list_id``, one for each of their nearest lists."""
        centres = self.centres

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            d = distances(unit(np.array(v.tolist(), np.float64)), centres)
            return pd.Series(np.argsort(d, axis=1, kind="stable")[:, :lists].tolist())

        return rows.where(F.size(self.vector_col) == centres.shape[1]).withColumn("list_id", F.explode(near(self.vector_col)))

    def radius(self, queries: DataFrame, least: float, query_col: str = "query_id", digits: int = 6) -> DataFrame:
        """(query, id, score): every row of at least this cosine, as an exact scan finds it."""
        reach = (2 - 2 * (least - 0.5 * 10**-digits)) ** 0.5  # scores are rounded before they are compared
        return dense.search(self.rows, self._asked(queries, reach, query_col), None, least=least, same=("list_id",), id_col=self.id_col, query_col=query_col, vector_col=self.vector_col, digits=digits, dealt=True)

    def share_read(self, queries: DataFrame, least: float, query_col: str = "query_id") -> float:
        """The part of the rows that a radius search compares with a query, on the average."""
        reach = (2 - 2 * least) ** 0.5
        asked = {r.list_id: r["count"] for r in self._asked(queries, reach, query_col).groupBy("list_id").count().collect()}
        total = sum(n for n, _ in self.radii.values()) * max(1, queries.count())
        return sum(self.radii[c][0] * k for c, k in asked.items()) / max(1, total)


def inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """The k largest inner products by an index of distances.

    With one more component, the root of M^2 - |v|^2 for the largest norm M, all vectors are of
    length M and the nearest to a query (with 0 there) have its largest inner products:
    |q|^2 + M^2 - 2 qv is the squared distance.
    """
    square = dense.inner_product(F.col(vector_col), F.col(vector_col))
    most = vectors.agg(F.max(square)).first()[0] or 0.0
    added = vectors.select(id_col, F.concat(F.transform(vector_col, lambda x: x.cast("double")), F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(most) - square)))).alias(vector_col))
    asked = queries.select(query_col, F.concat(F.transform(vector_col, lambda x: x.cast("double")), F.array(F.lit(0.0))).alias(vector_col), square.alias("_square"))
    near = dense.search(added, asked, 2 * k, "l2", id_col=id_col, query_col=query_col, vector_col=vector_col, digits=12).drop("rank")
    product = (F.col("_square") + most - F.col("score") * F.col("score")) / 2
    found = near.join(asked.select(query_col, "_square"), query_col).select(query_col, id_col, (F.round(product, digits) + 0.0).alias("score"))
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Codes:
    """Product codes: ``rows`` (id, code) of half a byte for each pair of components; ``books`` has 16 centres for each pair."""

    rows: DataFrame
    books: np.ndarray
    vectors: DataFrame
    id_col: str
    vector_col: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> Codes:
        x = unit(sample(vectors, SAMPLE, id_col, vector_col))
        width = x.shape[1]
        pairs = -(-width // 2)
        wide = np.zeros((len(x), 2 * pairs))
        wide[:, :width] = x
        books = np.zeros((pairs, 16, 2))
        for j in range(pairs):
            c = kmeans(wide[:, 2 * j : 2 * j + 2], 16, seed=j)
            books[j, : len(c)] = c

        @F.pandas_udf("binary")
        def coded(v: pd.Series) -> pd.Series:
            y = np.zeros((len(v), 2 * (pairs + pairs % 2)))
            y[:, :width] = unit(np.array(v.tolist(), np.float64))
            code = np.zeros((len(v), pairs + pairs % 2), np.uint8)
            for j in range(pairs):
                code[:, j] = distances(y[:, 2 * j : 2 * j + 2], books[j]).argmin(axis=1)
            return pd.Series([r.tobytes() for r in code[:, ::2] | code[:, 1::2] << 4])

        of_width = vectors.where(F.size(vector_col) == width) if len(x) else vectors.limit(0)
        of_width.select(id_col, coded(vector_col).alias("code")).write.mode("overwrite").option("compression", "none").parquet(f"{path}/codes")
        return cls(vectors.sparkSession.read.parquet(f"{path}/codes"), books, of_width.select(id_col, vector_col), id_col, vector_col)

    def search(self, queries: DataFrame, k: int = 10, refine: int = 10, query_col: str = "query_id", per: int = 8192) -> DataFrame:
        """The k nearest by cosine among the ``refine`` times k best by code."""
        books, id_col, pairs = self.books, self.id_col, len(self.books)
        width = self.vectors.where(F.size(self.vector_col) > 0).select(F.size(self.vector_col)).first()
        asked = queries.where(F.size(self.vector_col) == (width[0] if width else 0)).select(query_col, self.vector_col)
        held = asked.limit(MOST_QUERIES + 1).toPandas()
        if len(held) > MOST_QUERIES:
            raise ValueError(f"ask for at most {MOST_QUERIES} queries at a time")
        q = np.zeros((len(held), 2 * pairs), np.float32)
        if len(held):
            v = unit(np.array(held[self.vector_col].tolist(), np.float64))
            q[:, : v.shape[1]] = v
        tables = np.einsum("qjd,jcd->qjc", q.reshape(len(held), pairs, 2), books).astype(np.float32)  # products of each query and centre
        names = held[query_col].to_numpy()
        sent = self.rows.sparkSession.sparkContext.broadcast((names, tables))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, tables = sent.value
            for f in frames:
                for at in range(0, len(f), per):
                    part = f.iloc[at : at + per]
                    ids = part[id_col].to_numpy()
                    packed = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    code = np.empty((len(part), 2 * packed.shape[1]), np.uint8)
                    code[:, ::2], code[:, 1::2] = packed & 15, packed >> 4
                    for name, t in zip(names, tables, strict=True):
                        s = np.zeros(len(part), np.float32)
                        for j in range(pairs):
                            s += t[j][code[:, j]]
                        best = np.lexsort([ids, -s])[: k * refine]
                        yield pd.DataFrame({query_col: name, id_col: ids[best], "score": s[best].astype(np.float64)})

        first = self.rows.mapInPandas(run, f"{query_col} long, {id_col} long, score double")
        w = Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(id_col))
        few = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k * refine).select(query_col, id_col)
        both = few.join(self.vectors, id_col).join(asked.select(query_col, F.col(self.vector_col).alias("_asked")), query_col)
        scored = both.select(query_col, id_col, F.round(dense.cosine(F.col(self.vector_col), F.col("_asked")), 6).alias("score"))
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
