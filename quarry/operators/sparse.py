"""BM25: corpus statistics, document and query weights, boolean and ranked retrieval."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import stored

K1, B = 1.2, 0.75
UNKNOWN = 0.1
#: Runs of letters and digits whose terms a worker remembers, and documents that a bucket of counts has.
REMEMBERED, BUCKET = 500_000, 5_000
_STOP = frozenset(T.STOP_WORDS)


def run_terms(run: str) -> list[str]:
    """The kept terms of a run of letters and digits, as ``text.tokenize`` gives them."""
    parts, at = [], 0
    for i in range(1, len(run)):
        if unicodedata.category(run[i - 1]) != "Lu" == unicodedata.category(run[i]):
            parts.append(run[at:i])
            at = i
    return [t for t in (p.lower() for p in [*parts, run[at:]]) if len(t.encode()) >= 2 and t not in _STOP]


def hashed(term: str) -> int:
    h = 2166136261
    for b in term.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % T.TERM_SPACE


def spread(docs: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is dealt out first; larger inputs stay where they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    few = docs._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return docs.repartition(cores) if few else docs


def tokens(docs: DataFrame, id_col: str, text_col: str, by_id: bool = False) -> DataFrame:
    """(id, term): a row for each kept token. With ``by_id`` texts are dealt by id, so what is grouped by id next needs no shuffle of tokens."""
    rows = docs.select(id_col, text_col)
    rows = rows.repartition(id_col) if by_id else spread(rows)
    runs = rows.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(T.RUNS), F.lit(1))).alias("run"))
    return runs.select(id_col, F.explode(F.split("run", T.CAMEL)).alias("term")).select(id_col, F.lower("term").alias("term")).where(T.kept_term(F.col("term")))


#: What a Python worker has met, over its tasks.
_KNOWN: dict[str, list[tuple[str, int]]] = {}


def terms_of(run: str) -> list[tuple[str, int]]:
    """The kept terms of a run with their hashes."""
    kept = _KNOWN.get(run)
    if kept is None:
        if len(_KNOWN) >= REMEMBERED:
            _KNOWN.clear()
        kept = _KNOWN[run] = [(t, hashed(t)) for t in run_terms(run)]
    return kept


def words_of(runs: pa.ListArray) -> Iterator[list[str]]:
    """The strings of each list; equal ones are one object, made once."""
    at = runs.offsets.to_numpy()
    words = runs.flatten().dictionary_encode()
    named, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
    at = (at - at[0]).tolist()
    for a, b in zip(at, at[1:]):  # noqa: B905
        yield [named[c] for c in codes[a:b].tolist()]


def counted(docs: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """(id, n_rows, n_tokens, n_terms, posts): a row for each id with the frequencies of its term hashes.

    Texts are dealt by id and sorted by it; a task reads them one after the other and holds the
    counts of one id and some known words, so its memory doesn't grow with what it reads. No token
    crosses the network or is a row of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(*([partitions] if partitions else []), id_col).sortWithinPartitions(id_col)
    rows = rows.select(id_col, F.regexp_extract_all("text", F.lit(T.RUNS), F.lit(1)).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the id that may go on, its rows and counts of runs
        for batch in batches:
            step = max(1, int(batch.num_rows * 4_000_000 / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ended = []
                for name, words in zip(part.column(0).to_pylist(), words_of(part.column(1)), strict=True):
                    if held and held[0] == name:
                        held[1] += 1
                        held[2].update(words)
                    else:
                        if held:
                            ended.append(held)
                        held = [name, 1, Counter(words)]
                yield _counts(ended, part.schema.field(0))
        if held:
            yield _counts([held], part.schema.field(0))

    return rows.mapInArrow(run, f"{id_col} {kind}, n_rows long, n_tokens long, n_terms long, posts array<struct<term_hash: int, tf: bigint>>")


def _counts(ended: list, named: pa.Field) -> pa.RecordBatch:
    """Rows of ``counted`` from counts of runs."""
    tokens, terms, hashes, tfs, bounds = [], [], [], [], [0]
    for _, _, runs in ended:
        found: dict[str, int] = {}
        by_hash: dict[int, int] = {}
        for w, n in runs.items():
            for t, h in terms_of(w):
                found[t] = found.get(t, 0) + n
                by_hash[h] = by_hash.get(h, 0) + n
        tokens.append(sum(found.values()))
        terms.append(len(found))
        hashes += by_hash.keys()
        tfs += by_hash.values()
        bounds.append(len(hashes))
    posts = pa.StructArray.from_arrays([pa.array(hashes, pa.int32()), pa.array(tfs, pa.int64())], ["term_hash", "tf"])
    cols = [pa.array([x[0] for x in ended], named.type), pa.array([x[1] for x in ended], pa.int64()), pa.array(tokens, pa.int64()), pa.array(terms, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), posts)]
    return pa.RecordBatch.from_arrays(cols, [named.name, "n_rows", "n_tokens", "n_terms", "posts"])


def listed(counts: DataFrame, id_col: str) -> DataFrame:
    """(id, dl, term_hash, tf) of counted documents, where they are."""
    return counts.select(id_col, F.col("n_tokens").alias("dl"), F.inline("posts"))


def frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term_hash, tf): the texts cross the network once, tokens never."""
    return listed(counted(docs, id_col, text_col), id_col).drop("dl")


def idf(n: Column, df: Column) -> Column:
    return F.when((df > 0) & (n > 0), F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))


class Bm25:
    """Statistics of a corpus: ``tf`` (id, term_hash, tf), ``df`` (term_hash, df), n and avgdl as one-row ``stats``.

    All of them come from counts of documents, which are kept (spilling to disk) so that texts
    are tokenized once; ``close`` lets them go. A stored ``tf`` may be given instead, or ``counts``.
    """

    def __init__(self, docs: DataFrame | None, id_col: str = "id", text_col: str = "content", tf: DataFrame | None = None, counts: DataFrame | None = None):
        self.id_col = id_col
        self._kept = None
        if tf is None and counts is None:
            self._kept = counts = counted(docs, id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)
        if counts is not None:  # lengths are known
            self.sized = listed(counts, id_col)
            self.tf = self.sized.drop("dl")
            size = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
        else:
            self.tf = tf
            self.sized = tf.withColumn("dl", F.sum("tf").over(Window.partitionBy(id_col)))  # partitioned by id already
            size = docs.agg(F.count("*").alias("n")).crossJoin(tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")))
        self.df = self.tf.groupBy("term_hash").agg(F.count("*").alias("df"))
        self.stats = size.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))

    @classmethod
    def stored(cls, docs: DataFrame, path: str, id_col: str = "id", text_col: str = "content") -> Bm25:
        """Counts, bucketed by id with some thousand documents in each bucket, and what follows from them, written once."""
        spark = docs.sparkSession
        buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(4000, docs.count() // BUCKET))
        counts = counted(docs, id_col, text_col, buckets)
        model = cls(None, id_col, counts=stored.bucketed(counts, f"{path}/counts", id_col, [id_col], buckets, dealt=True))
        model.df, model.stats = stored.written(model.df, "df"), stored.written(model.stats, "stats")
        return model

    def asked(self, queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """The weights of queries, made once, and broadcast to the postings if they are few."""
        return stored.small(stored.written(self.query(queries, query_col, text_col), "asked"))

    def close(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()

    def postings(self) -> DataFrame:
        """(id, term_hash, weight): BM25 weights of documents; terms without positive idf are left out."""
        # df has at most TERM_SPACE rows
        rows = self.sized.join(F.broadcast(self.df), "term_hash").crossJoin(F.broadcast(self.stats))
        rate = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        value = idf(F.col("n"), F.col("df"))
        return rows.where(value > 0).select(self.id_col, "term_hash", (value * F.col("tf") * (K1 + 1) / rate).alias("weight"))

    def query(self, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """(query_id, term_hash, weight): the idf of each token, summed; 0.1 for terms the corpus lacks."""
        q = frequencies(queries, id_col, text_col).join(F.broadcast(self.df), "term_hash", "left").crossJoin(F.broadcast(self.stats))
        return q.select(id_col, "term_hash", (F.col("tf") * F.when(F.col("df").isNull(), F.lit(UNKNOWN)).otherwise(idf(F.col("n"), F.col("df")))).alias("weight"))


def shifted(df: DataFrame, stats: DataFrame, gone: DataFrame, fresh: DataFrame, rows: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Document frequencies (term_hash, df) and size (n, total) after a change, without a fit of what stays.

    ``gone`` and ``fresh`` are the counts (id, term_hash, tf) of the documents that leave, as they
    were, and of those that come; ``rows`` is how many more documents there are now. Only these
    and the frequencies, of which there are ``TERM_SPACE`` at most, are read.
    """
    moved = gone.select("term_hash", F.lit(-1).alias("df"), (-F.col("tf")).alias("tf")).union(fresh.select("term_hash", F.lit(1).alias("df"), "tf"))
    moved = stored.written(moved.groupBy("term_hash").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "moved")  # asked for twice
    after = df.select("term_hash", "df").union(moved.select("term_hash", "df")).groupBy("term_hash").agg(F.sum("df").alias("df")).where("df > 0")
    change = moved.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))
    return after, stats.crossJoin(F.broadcast(change)).select((F.col("n") + rows).alias("n"), (F.col("total") + F.col("tf")).alias("total"))


def top_k(scored: DataFrame, k: int, query_col: str, id_col: str, digits: int = 6) -> DataFrame:
    """The k best ids of each query: rounded score, ties by id; the limit reaches below the shuffle."""
    rounded = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(id_col))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(postings: DataFrame, query: DataFrame, id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """Sparse dot products: an equi-join on the term hash; AQE broadcasts the query side where its size allows."""
    d, q = postings.withColumnRenamed("weight", "wd"), query.withColumnRenamed("weight", "wq")
    return d.join(q, "term_hash").groupBy(query_col, id_col).agg(F.sum(F.col("wd") * F.col("wq")).alias("score"), F.count("*").alias("matched"))


def match_all(postings: DataFrame, query: DataFrame, id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """Only documents that hold every query term."""
    wanted = query.groupBy(query_col).agg(F.count("*").alias("wanted"))
    return dot(postings, query, id_col, query_col).join(wanted, query_col).where("matched = wanted").drop("matched", "wanted")
