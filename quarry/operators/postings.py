"""A stored keyword index: positional postings, laid out by document.

A document is tokenized once, within its row: texts cross no network, and what is shuffled
is one row for each of its terms, with count and positions. The table is bucketed by document
and ordered by term hash in each bucket. So

* counting, phrases and boolean queries group by document and need no exchange;
* a scan for a few terms skips the row groups of all others;
* no term's postings have to fit a task, however frequent it is.

A document without terms, and every other, has one row of the empty term (hash -1) with its
length, so the table also tells how many there are. Rows of one id are documents of their own
(``row`` tells them apart). Null text: no terms. Null ids are kept, as one id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import stored
from . import filters, sparse

NO_TERM = -1
run_terms, hashed = sparse.run_terms, sparse.hashed


def query_terms(text: str) -> list[str]:
    """The terms of a query's words, by the rule of the index."""
    return [t for r in regex.findall(T.RUNS, text) for t in run_terms(r)]


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, term_hash, term, tf, dl, positions) of every document, made row by row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = sparse.spread(docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")))
    rows = rows.select(id_col, F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(T.RUNS), F.lit(1)).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 4_000_000 / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                index, hashes, terms, counts, lengths, places, bounds = [], [], [], [], [], [], [0]
                for i, words in enumerate(sparse.words_of(part.column(2))):
                    found: dict[tuple[str, int], list[int]] = {}
                    n = 0
                    for w in words:
                        for t in sparse.terms_of(w):
                            found.setdefault(t, []).append(n)
                            n += 1
                    found[("", NO_TERM)] = []
                    for (term, h), positions in found.items():
                        index.append(i)
                        hashes.append(h)
                        terms.append(term)
                        counts.append(len(positions))
                        lengths.append(n)
                        places += positions
                        bounds.append(len(places))
                at_rows = pa.array(index, pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places, pa.int32()))
                cols = [part.column(0).take(at_rows), part.column(1).take(at_rows), pa.array(hashes, pa.int32()), pa.array(terms), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "row", "term_hash", "term", "tf", "dl", "positions"])

    return rows.mapInArrow(run, f"{id_col} {kind}, row long, term_hash int, term string, tf long, dl long, positions array<int>")


@dataclass
class Index:
    """Stored postings of a corpus, its document frequencies by term hash (65,536 at most) and its size."""

    table: DataFrame
    id_col: str
    df: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "id", text_col: str = "content", buckets: int | None = None) -> Index:
        spark = docs.sparkSession
        buckets = buckets or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        table = stored.bucketed(located(docs, id_col, text_col), f"{path}/postings", id_col, ["term_hash", "term"], buckets)
        meta = json.dumps({"id": id_col, "kind": docs.schema[id_col].dataType.simpleString(), "buckets": buckets})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        index = cls(table, id_col, table, table)
        index.frequencies.groupBy("term_hash").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/df")
        index.rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{path}/stats")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        like = spark.createDataFrame([], f"{meta['id']} {meta['kind']}, row long, term_hash int, term string, tf long, dl long, positions array<int>")
        table = stored.opened(spark, f"{path}/postings", like, meta["id"], ["term_hash", "term"], meta["buckets"])
        return cls(table, meta["id"], spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/stats"))

    @property
    def rows(self) -> DataFrame:
        """(id, row, dl): every document."""
        return self.table.where(F.col("term_hash") == NO_TERM).select(self.id_col, "row", "dl")

    @property
    def frequencies(self) -> DataFrame:
        """(id, term_hash, tf), as ``sparse.frequencies`` counts them."""
        return self.table.where(F.col("term_hash") > NO_TERM).groupBy(self.id_col, "term_hash").agg(F.sum("tf").alias("tf"))

    def bm25(self) -> sparse.Bm25:
        """BM25 over the stored counts: nothing is tokenized, nothing of the corpus is shuffled."""
        model = sparse.Bm25(self.rows, self.id_col, tf=self.frequencies)
        model.df, model.stats = self.df, self.stats.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
        return model

    def asked(self, queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """The weights of queries, made once, and broadcast to the postings if they are few."""
        return self.bm25().asked(queries, query_col, text_col)

    def matches(self, phrases: list[list[str]]) -> DataFrame:
        """(id, row, dl, f0, f1, ..): documents with any of the phrases (lists of terms), and how often each stands there."""
        spark = self.table.sparkSession
        asked = spark.createDataFrame([(i, k, len(p), t) for i, p in enumerate(phrases) for k, t in enumerate(p)], "phrase int, k int, m int, term string")
        terms = sorted({t for p in phrases for t in p})
        held = self.table.where(F.col("term_hash").isin(sorted({hashed(t) for t in terms})) & F.col("term").isin(terms))
        # a table of the query's own words; terms of a phrase meet where they would begin it
        starts = F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.transform("positions", lambda p: p - F.col("k")))
        met = held.join(F.broadcast(asked), "term").select(self.id_col, "row", "dl", "phrase", "m", "tf", F.explode(starts).alias("start"))
        key = [self.id_col, "row", "dl"]
        whole = met.groupBy(*key, "phrase", "m", "start").agg(F.count("*").alias("n"), F.max("tf").alias("tf")).where("n = m")
        found = whole.groupBy(*key, "phrase").agg(F.when(F.max("m") == 1, F.max("tf")).otherwise(F.count("*")).alias("n"))
        return found.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("phrase") == i, F.col("n"))), F.lit(0)).alias(f"f{i}") for i in range(len(phrases))])

    def _parsed(self, text: str) -> tuple[list[list[str]], Column]:
        phrases: list[list[str]] = []

        def atom(words: str) -> Column:
            terms = query_terms(words)
            if not terms:
                return F.lit(None).cast("boolean")
            if terms not in phrases:
                phrases.append(terms)
            return F.col(f"f{phrases.index(terms)}") > 0

        return phrases, filters.text_query(text, atom)

    def boolean(self, text: str) -> DataFrame:
        """(id, row): documents that satisfy a boolean text query (``filters.text_query``)."""
        phrases, wanted = self._parsed(text)
        if not phrases:
            return self.rows.where(wanted).select(self.id_col, "row")
        found = self.matches(phrases)
        none = {f"f{i}": F.lit(0) for i in range(len(phrases))}
        if self.table.sparkSession.range(1).select(*[v.alias(k) for k, v in none.items()]).where(wanted).isEmpty():
            return found.where(wanted).select(self.id_col, "row")  # without any of its words no document is wanted
        every = self.rows.alias("r").join(found.alias("f"), (F.col(f"r.{self.id_col}").eqNullSafe(F.col(f"f.{self.id_col}"))) & (F.col("r.row") == F.col("f.row")), "left")
        every = every.select(f"r.{self.id_col}", "r.row", *[F.coalesce(F.col(f"f.{k}"), F.lit(0)).alias(k) for k in none])
        return every.where(wanted).select(self.id_col, "row")

    def ranked(self, text: str, k: int | None = 10, digits: int = 6) -> DataFrame:
        """(id, row, score, rank): the documents of a boolean query by BM25 over its words and phrases, those under NOT or ``-`` aside.

        A phrase counts as a term: its frequency is that of its occurrences, its document
        frequency that of the documents that hold it.
        """
        phrases, wanted = self._parsed(text)
        barred = _barred(self.table.sparkSession, phrases, wanted)
        found = self.matches(phrases) if phrases else self.rows
        size = self.stats.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl")).first()
        df = found.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(phrases))]).first() if phrases else ()
        score = F.lit(0.0)
        for i in range(len(phrases)):
            if i not in barred:
                rate = F.col(f"f{i}") + sparse.K1 * (1 - sparse.B + sparse.B * F.col("dl") / (size.avgdl or 1.0))
                score = score + sparse.idf(F.lit(size.n), F.lit(df[i] or 0)) * F.col(f"f{i}") * (sparse.K1 + 1) / rate
        hits = found.where(wanted).select(self.id_col, "row", F.round(score, digits).alias("score")).where("score > 0")
        if k is not None:
            hits = hits.orderBy(F.desc("score"), self.id_col, "row").limit(k)
        return hits


def _barred(spark: SparkSession, phrases: list[list[str]], wanted: Column) -> set[int]:
    """Phrases whose presence never helps: those that stand under a negation only."""
    n = len(phrases)
    if not n or n > 12:
        return set()
    cases = spark.range(1 << n).select("id", *[(F.shiftright("id", i).bitwiseAND(F.lit(1))).alias(f"f{i}") for i in range(n)]).withColumn("ok", wanted)
    ok = {r.id: r.ok for r in cases.select("id", "ok").collect()}
    helps = {i for i in range(n) for s in ok if s >> i & 1 and ok[s] and not ok[s ^ 1 << i]}
    hurts = {i for i in range(n) for s in ok if s >> i & 1 and not ok[s] and ok[s ^ 1 << i]}
    return hurts - helps
