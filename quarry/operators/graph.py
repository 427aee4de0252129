"""A nearest-neighbour graph: made by joining neighbours of neighbours, searched by expanding a bounded frontier.

Each row starts with the nearest of those filed in its nearest lists; every round then joins
its neighbours' neighbours and keeps the best ``degree``. A row meets its neighbours' neighbours
where the neighbour is: the vectors of those that point to it, in blocks, and of those it points
to are one matrix product, and only pairs that can still be among the best go on. So a vector
travels once for each edge, not for each pair. A search
begins at the best rows of the lists nearest to a query (so copies and islands of close rows, whose
neighbours are all of their own kind, are met wherever they are) and expands the best ``width`` rows
found so far, all queries at once: one join to the stored edges and one to the vectors for each
step, until no better row is left to expand. What a step adds is bounded by width times degree
for each query; nothing is collected but the number of rows still to expand.

Scores are cosines. Null and empty vectors, and those of another length than the most common,
are in no list and so in no graph. Copies are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from . import dense, vectors


#: Rows that point to one neighbour and meet its neighbours in one block.
BLOCK = 64


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node by score, then id; pairs that come several times count once."""
    w = Window.partitionBy("node").orderBy(F.desc("score"), "near")
    return pairs.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= k).drop("_n").distinct()


def _further(pairs: DataFrame, packed: DataFrame, kind: type, degree: int, digits: int = 6) -> DataFrame:
    """(node, near, score): each node's neighbours' neighbours that reach the score of its last neighbour, or all while it has fewer than ``degree``."""
    floors = pairs.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
    blocks = pairs.groupBy("near").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asks = floors.join(packed.withColumnRenamed("id", "node"), "node").join(pairs.select("node", F.col("near").alias("by")), "node").join(blocks.withColumnRenamed("near", "by"), "by")
    asks = asks.groupBy("by", F.pmod(F.xxhash64("node"), "blocks").alias("block")).agg(F.collect_list(F.struct("node", "v", "floor")).alias("asks"))  # about BLOCK
    holds = pairs.select(F.col("node").alias("by"), F.col("near").alias("id")).join(packed, "id").groupBy("by").agg(F.collect_list(F.struct("id", "v")).alias("holds"))  # at most ``degree``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a_at, a), (h_at, h) = (_parts(batch.column(i)) for i in (0, 1))
            a_id, a_v, floor = a[0].to_numpy(), _matrix(a[1], kind), a[2].to_numpy()
            h_id, h_v = h[0].to_numpy(), _matrix(h[1], kind)
            out = []
            for i in range(batch.num_rows):
                x, y = slice(a_at[i], a_at[i + 1]), slice(h_at[i], h_at[i + 1])
                s = np.round(a_v[x] @ h_v[y].T, digits) + 0.0
                row, col = np.nonzero((s >= floor[x][:, None]) & (a_id[x][:, None] != h_id[y][None]))
                out.append((a_id[x][row], h_id[y][col], s[row, col]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "near", "score"])

    return asks.join(holds, "by").select("asks", "holds").mapInArrow(run, "node long, near long, score double")


def _parts(lists: pa.ListArray) -> tuple[list[int], list[pa.Array]]:
    """Where each list begins and ends, and the fields of their elements."""
    at = lists.offsets.to_numpy()
    return (at - at[0]).tolist(), lists.flatten().flatten()


def _matrix(packed: pa.Array, kind: type) -> np.ndarray:
    """Unit vectors of packed ones; one of length zero stays."""
    return vectors.unit(np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1).astype(np.float64))


@dataclass
class Graph:
    """``edges`` (node, near): a row for each node with its neighbours, bucketed as ``rows`` (id, vector) are."""

    edges: DataFrame
    rows: DataFrame
    lists: vectors.Lists
    id_col: str
    vector_col: str

    @classmethod
    def build(cls, table: DataFrame, path: str, degree: int = 16, rounds: int = 2, homes: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> Graph:
        spark = table.sparkSession
        lists = vectors.Lists.build(table, f"{path}/in", id_col=id_col, vector_col=vector_col)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = stored.bucketed(lists.rows.select(id_col, vector_col), f"{path}/rows", id_col, [id_col], buckets)
        filed = lists.nearest(rows, homes)  # a row for each row and each of its nearest lists
        asked = filed.select(F.col(id_col).alias("node"), vector_col, "list_id")
        met = dense.search(filed, asked, degree + 1, same=("list_id",), id_col=id_col, query_col="node", vector_col=vector_col, dealt=True, ranked=False)
        pairs = stored.written(_best(met.select("node", F.col(id_col).alias("near"), "score").where("node <> near"), degree), "pairs")
        kind = dense.stored_as(rows, vector_col)

        @F.pandas_udf("binary")
        def packing(v: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(x, kind).tobytes() for x in v])

        packed = stored.written(rows.select(F.col(id_col).alias("id"), packing(vector_col).alias("v")), "packed")
        for _ in range(rounds):
            pairs = stored.written(_best(pairs.union(_further(pairs, packed, kind, degree)), degree), "pairs")
        edges = pairs.groupBy("node").agg(F.sort_array(F.collect_list("near")).alias("near"))  # at most ``degree`` each
        edges = stored.bucketed(edges, f"{path}/edges", "node", ["node"], buckets)
        return cls(edges, rows, lists, id_col, vector_col)

    def search(self, queries: DataFrame, k: int = 10, width: int = 48, starts: int = 4, most_steps: int = 30, query_col: str = "query_id", seen: bool = False) -> DataFrame:
        """(query, id, score, rank), or with ``seen`` every row that was compared."""
        asked = self.lists.nearest(queries.select(query_col, self.vector_col), starts)
        q = stored.small(stored.written(queries.select(F.col(query_col).alias("q"), F.col(self.vector_col).alias("_q")), "asked"), vectors.MOST_QUERIES)
        begin = dense.search(self.lists.rows, asked, width, same=("list_id",), id_col=self.id_col, query_col=query_col, vector_col=self.vector_col, dealt=True)

        def scored(pairs: DataFrame) -> DataFrame:
            held = self.rows.select(F.col(self.id_col).alias("node"), F.col(self.vector_col).alias("_v"))
            return pairs.join(held, "node").join(q, "q").select("q", "node", F.round(dense.cosine(F.col("_v"), F.col("_q")), 6).alias("score"))

        found = stored.written(begin.select(F.col(query_col).alias("q"), F.col(self.id_col).alias("node"), "score", F.lit(False).alias("done")), "found")
        for _ in range(most_steps):
            order = Window.partitionBy("q").orderBy(F.desc("score"), "node")
            ranked = found.withColumn("_n", F.row_number().over(order)).withColumn("now", ~F.col("done") & (F.col("_n") <= width))
            ranked = stored.written(ranked, "ranked")
            now = ranked.where("now")
            if now.isEmpty():
                break
            reached = now.select("q", "node").join(self.edges, "node").select("q", F.explode("near").alias("node")).distinct()
            fresh = scored(reached.join(ranked.select("q", "node"), ["q", "node"], "left_anti")).withColumn("done", F.lit(False))
            found = stored.written(ranked.select("q", "node", "score", (F.col("done") | F.col("now")).alias("done")).union(fresh), "found")
        out = found.select(F.col("q").alias(query_col), F.col("node").alias(self.id_col), "score")
        if seen:  # of the lists it began with, all rows
            listed = asked.select(query_col, "list_id").join(self.lists.rows.select("list_id", self.id_col), "list_id").select(query_col, self.id_col)
            return out.select(query_col, self.id_col).union(listed).distinct()
        w = Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(self.id_col))
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
