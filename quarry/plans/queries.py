"""Queries over the test tables, one for each operator, with the same in SQL.

Documents stand for files: the path is source/doc_id.lang and the project is the
source. Benchmark passages are the keyword queries. Vectors whose id is divisible
by 100 are the vector queries; hybrid queries pair a passage with the vector of
its number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import catalog, chunk, chunkers, collection, dense, evaluate, filters, fusion, graph, index, manifest, postings, render, sparse, vectors
from ..sources import embed, stored
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("source_file"), F.col("source").alias("project"), F.col("lang").alias("language"), F.lit("chunk").alias("symbol"), F.lit("").alias("name"), F.col("text").alias("content"))


_FILES = "files AS (SELECT doc_id AS id, source || '/' || doc_id || '.' || lang AS source_file, source AS project, lang AS language, 'chunk' AS symbol, '' AS name, text AS content FROM documents)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(name: str, table: str, key: str) -> str:
    cut = r"regexp_replace(w, '(\P{Lu})(\p{Lu})', '\1 \2', 'g')"
    return f"""{name} AS (SELECT {key}, term FROM (SELECT {key}, lower(unnest(string_split({cut}, ' '))) AS term FROM (SELECT {key}, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM {table}))
 WHERE octet_length(encode(term)) >= 2 AND term NOT IN ({_STOP}))"""


_HEX = "instr('0123456789ABCDEF', substr(hex(encode(term)), CAST(i * 2 + {} AS INTEGER), 1)) - 1"
_FNV = f"""CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(generate_series(0, octet_length(encode(term)) - 1), lambda i: CAST(({_HEX.format(1)}) * 16 + {_HEX.format(2)} AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 65536 AS INTEGER)"""


def _tf(name: str, table: str, key: str) -> str:
    return f"""{_tok(name + "_tok", table, key)}, {name}_n AS (SELECT {key}, term, count(*) AS n FROM {name}_tok GROUP BY ALL), {name}_v AS (SELECT term, {_FNV} AS term_hash FROM (SELECT DISTINCT term FROM {name}_n)),
 {name} AS (SELECT {key}, term_hash, CAST(sum(n) AS BIGINT) AS tf FROM {name}_n JOIN {name}_v USING (term) GROUP BY ALL)"""


_CORPUS = f"""{_tf("tf", "documents", "doc_id")}, df AS (SELECT term_hash, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf)::DOUBLE / greatest((SELECT count(*) FROM documents), 1) AS avgdl)"""
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
_POST = f"""post AS (SELECT doc_id, term_hash, {_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM tf GROUP BY ALL) USING (doc_id) JOIN df USING (term_hash), st WHERE {_IDF} > 0)"""
_QRY = f"""{_tf("qtf", "benchmark", "item_id")}, qry AS (SELECT item_id, term_hash, tf * CASE WHEN df IS NULL THEN 0.1 ELSE {_IDF} END AS weight FROM qtf LEFT JOIN df USING (term_hash), st)"""
_DOT = "hit AS (SELECT item_id, doc_id, sum(p.weight * q.weight) AS score, count(*) AS matched FROM post p JOIN qry q USING (term_hash) GROUP BY ALL)"


_INDEXES: dict[tuple[str, str], postings.Index] = {}


def _index(spark: SparkSession, d: str) -> postings.Index:
    """The stored keyword index of ``documents``: built by the first query that asks for it, read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = postings.Index.build(_t(spark, d, "documents"), stored.scratch(spark, "index"), "doc_id", "text")
    return _INDEXES[key]


_COUNTS: dict[tuple[str, str], sparse.Bm25] = {}


def _model(spark: SparkSession, d: str) -> sparse.Bm25:
    """The stored counts of ``documents``, made once as the index is; they have no positions."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COUNTS:
        _COUNTS[key] = sparse.Bm25.stored(_t(spark, d, "documents"), stored.scratch(spark, "counts"), "doc_id", "text")
    return _COUNTS[key]


def _bm25(spark: SparkSession, d: str) -> tuple[sparse.Bm25, DataFrame]:
    model = _model(spark, d)
    return model, model.asked(_t(spark, d, "benchmark"), "item_id", "text")


@query(f"WITH {_tok('tok', 'documents', 'doc_id')} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY ALL")
def tok_count(spark: SparkSession, d: str) -> DataFrame:
    return sparse.counted(_t(spark, d, "documents"), "doc_id", "text").where("n_tokens > 0").select("doc_id", "n_tokens", "n_terms")


@query(f"WITH {_tok('tok', 'documents', 'doc_id')} SELECT term, count(*) AS n FROM tok GROUP BY ALL ORDER BY n DESC, term LIMIT 100")
def tok_terms_top(spark: SparkSession, d: str) -> DataFrame:
    """A top-100 report."""
    return sparse.tokens(_t(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query(f"WITH {_tok('tok', 'documents', 'doc_id')} SELECT term, {_FNV} AS term_hash FROM (SELECT DISTINCT term FROM tok)")
def term_hash(spark: SparkSession, d: str) -> DataFrame:
    return sparse.tokens(_t(spark, d, "documents"), "doc_id", "text").select("term").distinct().withColumn("term_hash", T.term_hash("term"))


@query("SELECT doc_id, CASE WHEN length(flat) > 96 THEN substr(flat, 1, 96) || '...' ELSE flat END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)")
def one_line(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("SELECT doc_id, trim(repeat(source || ' ', 3)) || ' ' || trim(repeat(lang || ' ', 3)) || ' ' || trim(repeat(source || '/' || doc_id || '.' || lang || ' ', 2)) || ' ' || trim(text || ' ') AS weighted FROM documents WHERE text <> ''")
def weighted_text(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return _t(spark, d, "documents").where("text <> ''").select("doc_id", T.weighted_text(F.col("source"), F.col("lang"), file, F.col("text")).alias("weighted"))


@query(f"WITH {_CORPUS} SELECT term_hash, df FROM df")
def bm25_df(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).df.select("term_hash", "df")


@query(f"WITH {_CORPUS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_CORPUS} SELECT term_hash, round({_IDF}, 6) AS idf FROM df, st")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    m = _model(spark, d)
    return m.df.crossJoin(F.broadcast(m.stats)).select("term_hash", F.round(sparse.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_CORPUS}, {_POST} SELECT doc_id, term_hash, round(weight, 6) AS weight FROM post")
def bm25_doc_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).postings().select("doc_id", "term_hash", F.round("weight", 6).alias("weight"))


@query(f"WITH {_CORPUS}, {_QRY} SELECT item_id, term_hash, round(weight, 6) AS weight FROM qry")
def bm25_query_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)[1].select("item_id", "term_hash", F.round("weight", 6).alias("weight"))


_RANK = "row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {i})"
_BM_TOP = "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT item_id, doc_id, score, " + _RANK.format(q="item_id", i="doc_id") + " AS rank FROM (SELECT item_id, doc_id, round(score, 6) AS score FROM hit {where})) WHERE rank <= {k}"


@query(f"WITH {_CORPUS}, {_POST}, {_QRY}, {_DOT} " + _BM_TOP.format(where="", k=10))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    model, q = _bm25(spark, d)
    return sparse.top_k(sparse.dot(model.postings(), q, "doc_id", "item_id"), 10, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


@query(f"WITH {_CORPUS}, {_POST}, {_QRY}, {_DOT}, want AS (SELECT item_id, count(*) AS wanted FROM qry GROUP BY ALL) SELECT item_id, doc_id, round(score, 5) AS score FROM hit JOIN want USING (item_id) WHERE matched = wanted")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    model, q = _bm25(spark, d)
    return sparse.match_all(model.postings(), q, "doc_id", "item_id").select("item_id", "doc_id", F.round("score", 5).alias("score"))


def _vectors(spark: SparkSession, d: str, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, d, "embeddings")
    if dim:
        v = v.withColumn("embedding", F.slice("embedding", 1, dim))
    return v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _knn(score: str, extra: str = "TRUE", k: str = "rank <= 10", dim: str = "embedding", cols: str = "query_id, vec_id, score, CAST(rank AS INTEGER) AS rank") -> str:
    return f"""WITH v AS (SELECT vec_id, {dim}::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round({score}, 6) + 0.0 AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND {extra}),
 r AS (SELECT *, {_RANK.format(q="query_id", i="vec_id")} AS rank FROM s) SELECT {cols} FROM r WHERE {k}"""


_COS = "list_cosine_similarity(q.e, v.e)"
_HITS = ("query_id", "vec_id", "score", "rank")


@query(_knn(_COS))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d)).select(*_HITS)


@query(_knn("list_inner_product(q.e, v.e)"))
def knn_ip(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d), metric="ip").select(*_HITS)


@query(_knn("-list_distance(q.e, v.e)", extra="q.vec_id <> v.vec_id"))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    """Nearest others by distance, as negated scores."""
    hits = dense.search(*_vectors(spark, d), k=11, metric="l2", digits=6).where("query_id <> vec_id").drop("rank")
    return sparse.top_k(hits, 10, "query_id", "vec_id").select(*_HITS)


@query(_knn(_COS, extra="q.label = v.label"))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d), same=("label",)).select(*_HITS)


@query(_knn(_COS, k="score >= 0.3", cols="query_id, vec_id, score"))
def knn_radius(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d), k=None, least=0.3).select("query_id", "vec_id", "score")


@query(_knn(_COS, dim="embedding[1:32]"))
def knn_truncated_dim(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d, 32)).select(*_HITS)


@query(
    f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round({_COS}, 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS in_group FROM s), "
    "g AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS group_rank FROM r WHERE in_group = 1) "
    "SELECT query_id, label, vec_id, score, CAST(in_group AS INTEGER) AS in_group, CAST(group_rank AS INTEGER) AS group_rank FROM r JOIN g USING (query_id, label) WHERE in_group <= 3 AND group_rank <= 4"
)
def knn_group_by(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return dense.group_top(dense.search(v, q, k=3, group_col="label"), "label", 3, 4).select("query_id", "label", "vec_id", "score", "in_group", "group_rank")


@query()
def knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return dense.Ivf(v).search(q).select(*_HITS)


@query()
def knn_quantised(spark: SparkSession, d: str) -> DataFrame:
    return dense.quantised_search(*_vectors(spark, d)).select(*_HITS)


@query(_knn("list_inner_product(q.e, v.e)"))
def knn_mips(spark: SparkSession, d: str) -> DataFrame:
    """Largest inner products, found as nearest neighbours."""
    return vectors.inner_products(*_vectors(spark, d)).select(*_HITS)


@query(_knn(_COS, k="score >= 0.6", cols="query_id, vec_id, score"))
def knn_radius_lists(spark: SparkSession, d: str) -> DataFrame:
    """A radius search on stored lists; those that can hold no such row aren't read."""
    v, q = _vectors(spark, d)
    return vectors.Lists.build(v, stored.scratch(spark, "lists")).radius(q, 0.6).select("query_id", "vec_id", "score")


@query()
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours by a search of the neighbour graph."""
    v, q = _vectors(spark, d)
    return graph.Graph.build(v, stored.scratch(spark, "graph")).search(q).select(*_HITS)


@query()
def knn_codes(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by four bits for two components, ranked again by vectors."""
    v, q = _vectors(spark, d)
    return vectors.Codes.build(v, stored.scratch(spark, "codes")).search(q).select(*_HITS)


def _hybrid(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    model, q = _bm25(spark, d)
    n = fusion.prefetch(k)
    words = sparse.top_k(sparse.dot(model.postings(), q, "doc_id", "item_id"), n, "item_id", "doc_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), "score", "rank")
    v = _t(spark, d, "embeddings")
    asked = v.join(_t(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    near = dense.search(v, asked, k=n).select("query_id", F.col("vec_id").alias("id"), "score", "rank")
    return words, near


_LISTS = (
    f"{_CORPUS}, {_POST}, {_QRY}, {_DOT}, words AS (SELECT item_id AS query_id, doc_id AS id, score, rank FROM ({_BM_TOP.format(where='', k=30)})), "
    f"v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_COS}, 6) AS score FROM v q JOIN benchmark ON q.vec_id = item_id, v), "
    f"near AS (SELECT * FROM (SELECT *, {_RANK.format(q='query_id', i='id')} AS rank FROM s) WHERE rank <= 30), both_ AS (SELECT * FROM words UNION ALL SELECT * FROM near)"
)
_FUSED = "f AS (SELECT query_id, id, round(sum({part}), 6) AS score FROM {src} GROUP BY ALL) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, " + _RANK.format(q="query_id", i="id") + " AS rank FROM f) WHERE rank <= 10"
_FUSED_COLS = ("query_id", "id", "score", "rank")


@query(f"WITH {_LISTS}, " + _FUSED.format(part="1.0::DOUBLE / (2 + rank - 1)", src="both_"))
def rrf_k2(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(list(_hybrid(spark, d, 10)), 2).select(*_FUSED_COLS)


@query(f"WITH {_LISTS}, " + _FUSED.format(part="1.0::DOUBLE / (60 + rank - 1)", src="both_"))
def rrf_k60(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(list(_hybrid(spark, d, 10)), 60).select(*_FUSED_COLS)


_SCALED = "SELECT query_id, id, {w} * CASE WHEN max(score) OVER (PARTITION BY query_id) > min(score) OVER (PARTITION BY query_id) THEN (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) ELSE 1.0 END AS part FROM {t}"


@query(f"WITH {_LISTS}, parts AS ({_SCALED.format(w='0.3::DOUBLE', t='words')} UNION ALL {_SCALED.format(w='0.7::DOUBLE', t='near')}), " + _FUSED.format(part="part", src="parts"))
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(list(_hybrid(spark, d, 10)), [0.3, 0.7]).select(*_FUSED_COLS)


@query(f"WITH {_LISTS}, w AS (SELECT query_id, id, 2.0::DOUBLE / (60 + rank - 1) AS part FROM words UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank - 1) FROM near), " + _FUSED.format(part="part", src="w"))
def multi_query(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(list(_hybrid(spark, d, 10)), 60, weights=[2.0, 1.0]).select(*_FUSED_COLS)


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1, 60)) AS a0 FROM l) "
    "SELECT doc_id, CAST(a0 // 60 AS INTEGER) AS chunk_no, CAST(a0 + 1 AS INTEGER) AS start_line, CAST(least(a0 + 60, len(ls)) AS INTEGER) AS end_line, array_to_string(ls[a0 + 1:a0 + 60], chr(10)) AS content FROM c"
)
def chunk_lines_60(spark: SparkSession, d: str) -> DataFrame:
    return chunk.by_lines(_t(spark, d, "documents"), "doc_id", "text")


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1, 2)) AS a0 FROM l) "
    "SELECT doc_id, CAST(a0 // 2 AS INTEGER) AS chunk_no, CAST(a0 + 1 AS INTEGER) AS start_line, CAST(least(a0 + 2, len(ls)) AS INTEGER) AS end_line, array_to_string(ls[a0 + 1:a0 + 2], chr(10)) AS content FROM c"
)
def chunk_lines_2(spark: SparkSession, d: str) -> DataFrame:
    return chunk.by_lines(_t(spark, d, "documents"), "doc_id", "text", 2)


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, ls, unnest(generate_series(0, greatest(0, len(ls) - 3), 3)) AS a0 FROM l) "
    "SELECT doc_id, CAST(a0 // 3 AS INTEGER) AS chunk_no, CAST(a0 + 1 AS INTEGER) AS start_line, CAST(least(a0 + 5, len(ls)) AS INTEGER) AS end_line, array_to_string(ls[a0 + 1:a0 + 5], chr(10)) AS content FROM c"
)
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Five lines a chunk, of which two are those of the chunk before."""
    return chunk.by_lines(_t(spark, d, "documents"), "doc_id", "text", 5, 2)


@query()
def chunk_capped(spark: SparkSession, d: str) -> DataFrame:
    return chunk.capped(_t(spark, d, "documents"), "doc_id", "text")


@query()
def split_oversized(spark: SparkSession, d: str) -> DataFrame:
    return chunk.split_oversized(_t(spark, d, "documents"), "doc_id", "text", 400)


_CODE = {
    "py": "import os\n\n@cached\ndef first_{}(x):\n    return x\n\nclass Second:\n    def inner(self):\n        pass\n",
    "go": "package main\n\nfunc (r *Row) First() int {{\n\treturn {}\n}}\n\ntype Second struct {{\n\tx int\n}}",
    "sql": "create table first_{} (\n  x int\n);\nselect 1;",
    "txt": "no code {}\nat all",
}
_PARTS = {  # language, symbol, name, first and last line
    "py": [("python", "function", "'first_' || page_id", 3, 5), ("python", "class", "'Second'", 7, 9)],
    "go": [("go", "func", "'First'", 3, 5), ("go", "type", "'Second'", 7, 9)],
    "sql": [("sql", "create", "'first_' || page_id", 1, 3), ("sql", "select", "''", 4, 4)],
    "txt": [("txt", "chunk", "page_id || '.txt:1-2'", 1, 2)],
}


@query(
    " UNION ALL ".join(
        f"SELECT 'p/' || page_id || '.{x}' AS path, '{lang}' AS language, '{symbol}' AS symbol, {name} AS name, {a} AS start_line, {b} AS end_line, 0 AS part, array_to_string(string_split(replace('{_CODE[x].format('#')}', '#', page_id::VARCHAR), chr(10))[{a}:{b}], chr(10)) AS chunk FROM pages WHERE page_id % 4 = {k}"
        for k, x in enumerate(_CODE) for lang, symbol, name, a, b in _PARTS[x]
    )
)
def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A file for each page, of one of four kinds by its id; definitions of the three languages, packed lines of the other."""
    return chunk.chunks(_code_files(spark, d))


@query(ORACLES["ast_chunks"])
def chunks_by_function(spark: SparkSession, d: str) -> DataFrame:
    """The same through the table function, which looks the chunker up by language."""
    return chunkers.applied(_code_files(spark, d))


def _code_files(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page_id")
    extension = F.element_at(F.array(*map(F.lit, _CODE)), (page % 4 + 1).cast("int"))
    content = F.element_at(F.array(*[F.replace(F.lit(c.format("#")), F.lit("#"), page.cast("string")) for c in _CODE.values()]), (page % 4 + 1).cast("int"))
    return _t(spark, d, "pages").select(F.concat(F.lit("p/"), page.cast("string"), F.lit("."), extension).alias("path"), content.alias("content"))


_HELD = {  # language: what stands before and after a text that the language takes as no code
    "go": ("package p\n\nfunc F#() string {\n\treturn `", "`\n}\nfunc Last() {}\n"), "js": ("const a = 1;\nfunction f#() {\n  /* ", " */\n}\nclass Last {}\n"),
    "rb": ("def f#\n  x = <<~TEXT\n", "\n  TEXT\nend\nmodule Last\nend\n"), "sql": ("create function f#() returns text as $$\n", "\n$$ language sql;\nselect 1;\n"),
}
_FOUND = {"go": (("func", "F#", 3, 5), ("func", "Last", 6, 6)), "js": (("const", "a", 1, 1), ("function", "f#", 2, 4), ("class", "Last", 5, 5)), "rb": (("def", "f#", 1, 5), ("module", "Last", 6, 7)), "sql": (("create", "f#", 1, 3), ("select", "", 4, 4))}
_INNER = "replace(replace(replace(text, '`', ''), '*/', ''), '$$', '')"
_GROWS = {"go": 3, "js": 3, "rb": 3, "sql": 2}  # the line on which the text begins


@query(
    "WITH t AS (SELECT doc_id, doc_id % 4 AS kind, len(string_split("
    + _INNER
    + ", chr(10))) - 1 AS more FROM documents) "
    + " UNION ALL ".join(
        f"SELECT doc_id || '.{x}' AS path, '{dict(go='go', js='javascript', rb='ruby', sql='sql')[x]}' AS language, '{symbol}' AS symbol, replace('{name}', '#', doc_id::VARCHAR) AS name, CAST({a}{' + more' if a > _GROWS[x] else ''} AS INTEGER) AS start_line, "
        f"CAST({b}{' + more' if b > _GROWS[x] else ''} AS INTEGER) AS end_line FROM t WHERE kind = {k}"
        for k, x in enumerate(_HELD)
        for symbol, name, a, b in _FOUND[x]
    )
)
def definitions_around_text(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of files that hold a document as a raw string, a comment, a heredoc or a quoted body: whatever it says, they end where they end."""
    inner = F.replace(F.replace(F.replace("text", F.lit("`"), F.lit("")), F.lit("*/"), F.lit("")), F.lit("$$"), F.lit(""))
    name = F.col("doc_id").cast("string")
    of = lambda k: F.element_at(F.array(*[F.replace(F.lit(v[k]), F.lit("#"), name) for v in _HELD.values()]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(name, F.lit("."), F.element_at(F.array(*map(F.lit, _HELD)), (F.col("doc_id") % 4 + 1).cast("int")))
    return chunk.defined(_t(spark, d, "documents").select(path.alias("path"), F.concat(of(0), inner, of(1)).alias("content")))


_UUID = (
    "WITH h AS (SELECT id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(project || ':' || source_file || ':1')) AS h FROM files) "
    "SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"
)


@query(f"WITH {_FILES}, " + _UUID.removeprefix("WITH "))
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", ids.point_id(F.col("project"), F.col("source_file"), F.lit(1)).alias("point_id"))


@query(f"WITH {_FILES} SELECT id, project || '_code_hash64_64_spark' AS collection FROM files")
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", ids.collection_name(F.col("project"), F.lit("code"), F.lit("hash64"), F.lit(64), F.lit("spark")).alias("collection"))


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE contains(lower(content || chr(10) || source_file || chr(10) || symbol || chr(10) || name), 'that')")
def kw_filter(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(filters.chunk_filter(keyword="That")).select("id", "source_file")


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE regexp_matches(source_file, '^src1[^/]*/[^/]*\\.(en|fr)$') AND NOT source_file LIKE '%7.fr'")
def path_glob(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(filters.pattern_filter(F.col("source_file"), ["src1*/*.en", "src1*/**/*.fr"], ["**/*7.fr"])).select("id", "source_file")


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE NOT (source_file LIKE 'src3/%' OR source_file LIKE '%.de') OR source_file LIKE '%1.de' AND source_file NOT LIKE 'src3/%'")
def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(~filters.ignored(F.col("source_file"), ["*.de", "!*1.de", "src3/"])).select("id", "source_file")


@query(f"WITH {_FILES} SELECT id, octet_length(encode(content)) AS bytes FROM files WHERE octet_length(encode(content)) BETWEEN 1000 AND 3000 AND lower(language) = 'fr'")
def size_range(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).where(filters.chunk_filter(language="FR", least=1000, most=3000))
    return rows.select("id", F.octet_length("content").cast("long").alias("bytes"))


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE language = 'en' AND project = 'src5'")
def store_filter(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(filters.store_filter('language == "en" && project = "src5"')).select("id", "source_file")


@query(f"WITH {_FILES} SELECT 'language' AS facet, language AS value, count(*) AS n FROM files WHERE language <> '' GROUP BY ALL UNION ALL SELECT 'symbol', symbol, count(*) FROM files GROUP BY ALL UNION ALL SELECT 'project', project, count(*) FROM files GROUP BY ALL")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return collection.facets(_files(spark, d), "language", "symbol", "project")


@query(f"WITH {_FILES} SELECT id, source_file FROM files ORDER BY source_file, id LIMIT 25 OFFSET 25")
def page_2(spark: SparkSession, d: str) -> DataFrame:
    return collection.page(_files(spark, d).select("id", "source_file"), 2, 25, F.col("source_file"), F.col("id"))


@query("SELECT greatest(1, CAST(ceil(count(*) / 25) AS BIGINT)) AS pages FROM documents")
def page_count(spark: SparkSession, d: str) -> DataFrame:
    return collection.page_count(_files(spark, d))


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE id > 100 ORDER BY id LIMIT 50")
def scroll_page(spark: SparkSession, d: str) -> DataFrame:
    return collection.scroll(_files(spark, d).select("id", "source_file"), 100, 0)


@query(f"WITH {_FILES} SELECT id, source_file, content FROM files WHERE id = 42")
def get_point(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(filters.must({"id": 42})).select("id", "source_file", "content")


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE project = 'src7'")
def list_points(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(filters.must({"project": "src7"})).select("id", "source_file")


@query("SELECT count(*) AS points, max(len(embedding))::INTEGER AS vector_size FROM embeddings")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return collection.info(_t(spark, d, "embeddings"), "embedding")


@query(_knn(_COS, cols="query_id, vec_id, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.5 THEN 'mid' ELSE 'low' END AS band"))
def score_band(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d)).select("query_id", "vec_id", T.score_band(F.col("score")).alias("band"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fp_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("sha256"))


_SNAP = f"{_FILES}, was AS (SELECT source_file AS path, CASE WHEN id % 7 = 0 THEN 'old' ELSE sha256(content) END AS sha256 FROM files WHERE id % 10 <> 0), now_ AS (SELECT source_file AS path, sha256(content) AS sha256 FROM files WHERE id % 11 <> 0)"
_DIFF = "dif AS (SELECT coalesce(n.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.sha256 <> w.sha256 THEN 'modified' ELSE 'unchanged' END AS change FROM now_ n FULL JOIN was w ON n.path = w.path)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, d).select("id", F.col("source_file").alias("path"), ids.content_hash(F.col("content")).alias("sha256"))
    return f.where("id % 11 <> 0").drop("id"), f.where("id % 10 <> 0").select("path", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))


@query(f"WITH {_SNAP}, {_DIFF} SELECT path, change FROM dif")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return manifest.diff(*_snapshots(spark, d))


@query(f"WITH {_SNAP} SELECT path, sha256 FROM was WHERE path NOT IN (SELECT path FROM now_)")
def stale_anti(spark: SparkSession, d: str) -> DataFrame:
    now, was = _snapshots(spark, d)
    return manifest.stale(was, now)


@query(f"WITH {_SNAP} SELECT n.path, n.sha256 FROM now_ n LEFT JOIN was w ON n.path = w.path WHERE w.path IS NULL OR w.sha256 <> n.sha256")
def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return manifest.changed(*_snapshots(spark, d))


@query(
    f"WITH {_SNAP}, {_DIFF}, c AS (SELECT split_part(path, '/', 1) AS project, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM dif GROUP BY ALL), "
    "m AS (SELECT *, added + modified + deleted AS changes, CASE WHEN project IN ('src3', 'src4') THEN 'full' WHEN added + modified + deleted = 0 THEN 'none' WHEN (added + modified + deleted) * 2 > added + modified + unchanged THEN 'full' ELSE 'delta' END AS mode FROM c) "
    "SELECT *, CASE WHEN mode = 'full' THEN added + modified + unchanged <= 200 ELSE changes <= 50 END AS sync FROM m"
)
def reindex_plan(spark: SparkSession, d: str) -> DataFrame:
    """Two projects' stores have lost their points, so they are read anew."""
    now, was = _snapshots(spark, d)
    points = F.when(F.col("project").isin("src3", "src4"), 0).otherwise(1)
    return manifest.plan(manifest.diff(now, was).withColumn("project", F.split("path", "/")[0]), points, group=["project"])


@query(f"WITH {_SNAP} SELECT * FROM was WHERE path NOT IN (SELECT path FROM now_) OR path LIKE '%.de' UNION ALL SELECT * FROM now_ WHERE path NOT LIKE '%.de'")
def manifest_apply(spark: SparkSession, d: str) -> DataFrame:
    """All walked files but the German ones were handled."""
    now, was = _snapshots(spark, d)
    return manifest.apply(was, now, now.where(~F.col("path").endswith(".de")))


@query(f"WITH {_FILES}, fresh AS (SELECT id + 5 AS id, upper(source_file) AS source_file FROM files WHERE id % 3 = 0) SELECT id, source_file FROM files WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select("id", "source_file")
    return collection.upsert(f, f.where("id % 3 = 0").select((F.col("id") + 5).alias("id"), F.upper("source_file").alias("source_file")))


@query(f"WITH {_FILES} SELECT id, CASE WHEN id % 4 = 0 THEN upper(source_file) ELSE source_file END AS source_file, language FROM files")
def doc_merge(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select("id", "source_file", "language")
    return collection.update(f, f.where("id % 4 = 0").select("id", F.upper("source_file").alias("source_file"), F.lit(None).cast("string").alias("language")))


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE project NOT IN ('src3', 'src4')")
def delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select("id", "source_file", "project")
    return collection.delete_files(f, f.where(F.col("project").isin("src3", "src4")).select("source_file")).select("id", "source_file")


@query("WITH l AS (SELECT user_id AS id, event_type AS op, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id % 2 = 0), p AS (SELECT user_id AS id, max(value) AS value FROM events GROUP BY ALL) SELECT id, value FROM p WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, value FROM l WHERE n = 1 AND op <> 'error'")
def apply_changefeed(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    points = e.groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("value"))
    feed = e.where("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "value", F.col("event_id").alias("seq"))
    return collection.apply_changes(points, feed)


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(
    "WITH p AS (SELECT page_id, list_reverse(list_filter(list_transform(string_split(url, '/'), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-')), lambda s: s <> '')) AS s FROM pages) "
    "SELECT page_id, array_to_string(list_concat(s[1:1], list_filter(s[2:], lambda x: x NOT IN ('home', 'users', 'user', 'usr', 'opt', 'var', 'etc', 'tmp'))), '-') AS project FROM p"
)
def project_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.project_name(F.col("url")).alias("project"))


@query("SELECT user_id, event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 700 WHEN user_id % 3 = 0 THEN 400 ELSE greatest(128, least(2000, CAST(floor(user_id * 20 * 0.8) AS INTEGER))) END AS INTEGER) AS budget FROM events")
def chunk_tokens_rule(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    override = F.when(F.col("event_id") % 5 == 0, 700).otherwise(0)
    context = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") * 20).cast("int")
    return e.select("user_id", "event_id", chunk.token_budget(override, context).cast("int").alias("budget"))


@query("SELECT page_id, CASE WHEN length(url) <= 8 THEN '***' ELSE left(url, 4) || '...' || right(url, 4) END AS masked FROM pages WHERE url <> ''")
def mask_key(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").where("url <> ''").select("page_id", T.mask_key(F.col("url")).alias("masked"))


@query("SELECT user_id, event_id, event_type, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 3")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_job(_t(spark, d, "events"), "user_id", "ts", "event_id", 3).select("user_id", "event_id", "event_type", "nth")


_STATES = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'cancelled' WHEN 'view' THEN 'running' ELSE 'queued' END"


@query(f"WITH e AS (SELECT event_id // 4 AS job, {_STATES} AS kind, ts, event_id FROM events) SELECT job, CASE WHEN bool_or(kind = 'cancelled') THEN 'cancelled' WHEN bool_or(kind = 'failed') THEN 'failed' WHEN bool_or(kind = 'succeeded') THEN 'succeeded' WHEN bool_or(kind = 'running') THEN 'running' ELSE 'queued' END AS state, arg_max(kind, {{'a': ts, 'b': event_id}}) AS last FROM e GROUP BY ALL")
def job_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr(_STATES)
    e = _t(spark, d, "events").select(F.expr("event_id div 4").alias("job"), kind.alias("kind"), "ts", "event_id")
    return catalog.job_state(e, "job", "kind", "ts", "event_id")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'interrupted' ELSE event_type END AS status FROM events")
def mark_interrupted(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE event_type END")
    return catalog.interrupt(_t(spark, d, "events").select("event_id", status.alias("status")))


_TRUTH = "truth AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0)"


@query(
    f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0), h AS (SELECT * FROM (SELECT *, {_RANK.format(q='query_id', i='vec_id')} AS rank FROM s) WHERE rank <= 10), {_TRUTH} "
    "SELECT query_id, round(avg(CASE WHEN h.vec_id IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM truth LEFT JOIN h USING (query_id, vec_id) GROUP BY ALL"
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return evaluate.recall_within(dense.search(v, q), q, v, "label", "query_id", "vec_id")


def _pct(place: str) -> str:
    cols = ", ".join(f"s[CAST({place.format(p=p)} AS BIGINT) + 1] AS p{p}" for p in (50, 95, 99))
    return f"WITH g AS (SELECT event_type, list(value ORDER BY value) AS s, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT event_type, n, {cols} FROM g"


@query(_pct("least(greatest(ceil(n * {p} / 100) - 1, 0), n - 1)"))
def lat_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latencies(_t(spark, d, "events"), "value", ["event_type"])


@query(_pct("least((n * {p} + 99) // 100, n - 1)"))
def lat_percentiles_coded(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latencies(_t(spark, d, "events"), "value", ["event_type"], rule="coded")


@query(_pct("((n - 1) * {p}) // 100"))
def lat_percentiles_floor(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latencies(_t(spark, d, "events"), "value", ["event_type"], rule="floor")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL")
def lat_summary(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query(
    "WITH v AS (SELECT 'full' AS model, vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT 'half', vec_id, embedding[1:32]::DOUBLE[] FROM embeddings), "
    f"s AS (SELECT q.model, q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS score FROM v q JOIN v ON q.model = v.model WHERE q.vec_id % 100 = 0) "
    f"SELECT model, query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_RANK.format(q='model, query_id', i='vec_id')} AS rank FROM s) WHERE rank <= 5"
)
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    found = [dense.search(*_vectors(spark, d, dim), k=5).select(F.lit(name).alias("model"), *_HITS) for name, dim in (("full", None), ("half", 32))]
    return found[0].unionByName(found[1])


@query(
    f"WITH {_CORPUS}, {_POST}, {_QRY}, {_DOT}, h AS (SELECT item_id, source AS project, hit.doc_id, round(score, 6) AS score FROM hit JOIN documents USING (doc_id)) "
    f"SELECT item_id, project, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_RANK.format(q='item_id, project', i='doc_id')} AS rank FROM h) WHERE rank <= 3"
)
def search_across(spark: SparkSession, d: str) -> DataFrame:
    model, q = _bm25(spark, d)
    project = _t(spark, d, "documents").select("doc_id", F.col("source").alias("project"))
    hits = sparse.dot(model.postings(), q, "doc_id", "item_id").join(project, "doc_id").withColumn("score", F.round("score", 6))
    from pyspark.sql import Window

    w = Window.partitionBy("item_id", "project").orderBy(F.desc("score"), F.asc("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("item_id", "project", "doc_id", "score", "rank")


@query(
    "WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new_ FROM events), s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) "
    "SELECT user_id, epoch_us(min(ts)) AS start_us, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths, count(*) AS n FROM s GROUP BY user_id, sid"
)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = watch.quiet_periods(_t(spark, d, "events"), "4 hours", key="user_id", path="event_type")
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.array_join("paths", ",").alias("paths"), "n")


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, arg_max(value, {'a': ts, 'b': event_id}) AS value, count(*) AS events FROM events GROUP BY ALL")
def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return watch.latest_progress(_t(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "value").drop("ts")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def batch64(spark: SparkSession, d: str) -> DataFrame:
    return collection.upload_batches(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' UNION SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def changed_union(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "documents").select("doc_id", "source", "lang")
    return t.where("lang = 'en'").union(t.where("source in ('src1', 'src2')")).select("doc_id", "source").distinct()


@query("WITH c AS (SELECT DISTINCT source AS name, 'curated' AS origin FROM documents WHERE lang = 'en'), l AS (SELECT DISTINCT source AS name, 'live' AS origin FROM documents) SELECT * FROM c UNION ALL SELECT * FROM l WHERE name NOT IN (SELECT name FROM c)")
def merge_priority(spark: SparkSession, d: str) -> DataFrame:
    """Curated names first, then live ones of other names; live names come many times."""
    t = _t(spark, d, "documents")
    curated = t.where("lang = 'en'").select(F.col("source").alias("name"), F.lit("curated").alias("origin")).distinct()
    return catalog.merge_models(curated, t.select(F.col("source").alias("name"), F.lit("live").alias("origin")))


@query(f"WITH {_FILES} SELECT id, source_file FROM files WHERE (language IN ('en', 'fr') OR source_file LIKE 'src1%') AND NOT (id >= 20 AND id < 400) AND content IS NOT NULL AND project <> 'it''s && x'")
def store_filter_parsed(spark: SparkSession, d: str) -> DataFrame:
    text = """(language in ("en", 'fr') || source_file LIKE "src1%") and not (id >= 20 && id < 4e2) AND content is not null AND project != "it's && x" """
    return _files(spark, d).where(filters.store_filter(text)).select("id", "source_file")


@query(f"WITH {_FILES} SELECT project AS source_file, count(*) AS points FROM files GROUP BY ALL")
def points_per_file(spark: SparkSession, d: str) -> DataFrame:
    return collection.points_per_file(_files(spark, d).select("id", F.col("project").alias("source_file")))


@query(f"WITH {_FILES} SELECT id, source_file, CASE WHEN id % 5 = 0 THEN '(unknown)' ELSE language END AS language, symbol, name, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS INTEGER) AS start_line, 0 AS end_line, CAST(octet_length(encode(content)) AS INTEGER) AS size FROM files")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).withColumns({"language": F.when(F.col("id") % 5 == 0, "").otherwise(F.col("language")), "start_line": F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")), "end_line": F.lit(None).cast("string")})
    return collection.chunk_rows(f)


@query(_knn(_COS, extra="TRUE", k="rank <= 200 AND label = 3", cols="query_id, vec_id, score"))
def semantic_filter(spark: SparkSession, d: str) -> DataFrame:
    """The best 200 hits of each query, then those that meet a filter."""
    v, q = _vectors(spark, d)
    hits = dense.search(v, q, k=200).select("query_id", "vec_id", "score")
    return collection.hits_where(hits, v.select("vec_id", "label"), F.col("label") == 3, "vec_id").select("query_id", "vec_id", "score")


@query("SELECT user_id AS id, max(value) AS value FROM events GROUP BY ALL")
def upsert_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Every event writes its user's point; of several writes of one key the one of greatest ``value`` counts."""
    fresh = _t(spark, d, "events").where("value is not null").select(F.col("user_id").alias("id"), "value")
    return collection.upsert(fresh.where("id % 2 = 0").dropDuplicates(["id"]), fresh, seq="value")


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def seed_if_empty(spark: SparkSession, d: str) -> DataFrame:
    """An empty table takes the seed, the full one doesn't take a second."""
    seed = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    once = collection.seeded(seed.where("id < 0"), seed)
    return collection.seeded(once, seed.withColumn("name", F.lit("again")))


@query("SELECT vec_id, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS largest, label, (label = (SELECT max(label) FROM embeddings)) AS is_active FROM embeddings")
def active_flag(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    settings = v.agg(F.max("label").cast("string").alias("value")).withColumn("key", F.lit("active_model_id"))
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x))).cast("double")
    return catalog.with_active(v.withColumnRenamed("label", "id"), settings).select("vec_id", largest.alias("largest"), F.col("id").alias("label"), "is_active")


@query()
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return embed.hash_embedding(_t(spark, d, "documents"), "doc_id", "text")


_PADS = [bytes(x ^ p for x in b"machine-id".ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
_BYTE = "(instr('0123456789ABCDEF', substr(hex(encode(url)), CAST(i * 2 + {} AS INTEGER), 1)) - 1)"


@query(
    f"SELECT page_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(url)))) AS hmac, "
    f"lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(0, octet_length(encode(url)) - 1), lambda i: CAST({_BYTE.format(1)} * 16 + {_BYTE.format(2)} AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)), 16, '0')) AS fnv64 FROM pages"
)
def keyed_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", ids.keyed_hash(F.col("url"), "machine-id").alias("hmac"), ids.fnv64(F.col("url")).alias("fnv64"))


_Q = "'\"' || replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"'"


@query(
    f"WITH {_CORPUS}, {_POST}, {_QRY}, {_DOT}, top AS ({_BM_TOP.format(where='', k=3)}), "
    "one AS (SELECT item_id, rank, '--- Result ' || rank || ' (score: ' || printf('%.3f', round(score, 3)) || ') ---' || chr(10) || 'File: ' || source || '/' || doc_id || chr(10) || 'Symbol: ' || doc_id || ' (chunk)' || chr(10) || 'Lines: 1-' || len(string_split(text, chr(10))) || chr(10) || chr(10) "
    "|| '```' || lang || chr(10) || left(text, 80) || chr(10) || '```' || chr(10) || chr(10) AS t FROM top JOIN documents USING (doc_id)), "
    "g AS (SELECT item_id, count(*) AS n, string_agg(t, '' ORDER BY rank) AS t FROM one GROUP BY ALL), asked AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'the of') "
    f"SELECT a.item_id, 'Found ' || coalesce(n, 0) || ' results for ' || {_Q.format(c='a.text')} || ' in project \"all\":' || chr(10) || chr(10) || coalesce(t, '(no matches — try a different query or verify the project is indexed)' || chr(10)) AS results FROM asked a LEFT JOIN g USING (item_id)"
)
def rendered_results(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of each passage as text; one query has no terms and so no hits."""
    model, q = _bm25(spark, d)
    hits = sparse.top_k(sparse.dot(model.postings(), q, "doc_id", "item_id"), 3, "item_id", "doc_id")
    docs = _t(spark, d, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_file"), F.lit("chunk").alias("symbol"), F.col("doc_id").alias("name"), F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"), F.col("lang").alias("language"), F.left("text", F.lit(80)).alias("content"),
    )
    asked = _t(spark, d, "benchmark").select("item_id", "text")
    asked = asked.union(spark.range(1).select(F.lit(-1).cast(asked.schema["item_id"].dataType), F.lit("the of"))).withColumn("project", F.lit("all"))
    return render.results(hits.join(docs, "doc_id"), asked, "item_id")


@query()
def rendered_context(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d).withColumnsRenamed({"item_id": "query_id"})
    docs = _t(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), T.one_line(F.col("text")).alias("content"))
    rows = hits.join(docs, "doc_id")
    return render.context(rows, render.context_line(F.col("score"), F.col("file"), F.lit(1), F.lit(1), F.lit("chunk")), F.col("content"))


@query(
    f"WITH {_SNAP}, f AS (SELECT * FROM files WHERE id % 11 <> 0), old AS (SELECT source_file AS path, len(string_split(content, chr(10))) AS n FROM files WHERE id % 10 <> 0), "
    "same AS (SELECT n.path FROM now_ n JOIN was w ON n.path = w.path AND n.sha256 = w.sha256) "
    "SELECT split_part(f.source_file, '/', 1) AS project, count(*) AS files, CAST(sum(CASE WHEN same.path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS handled, CAST(sum(CASE WHEN same.path IS NULL THEN ceil(len(string_split(content, chr(10))) / 60) ELSE 1 END) AS BIGINT) AS points FROM f LEFT JOIN same ON f.source_file = same.path GROUP BY ALL"
)
def index_run(spark: SparkSession, d: str) -> DataFrame:
    """A delta run over a store that held one point of each file of the earlier snapshot: points that stay and points made anew."""
    now, was = _snapshots(spark, d)
    files = _files(spark, d).where("id % 11 <> 0").select(F.col("source_file").alias("path"), "content").join(now, "path")
    stored = was.select(ids.point_id(F.split("path", "/")[0], F.col("path"), F.lit(1)).alias("id"), F.col("path").alias("source_file"), F.lit(1).alias("start_line"), F.lit(60).alias("end_line"), F.lit("was").alias("content"))
    run = index.delta(files, was, stored, F.split("path", "/")[0])
    project = F.split("source_file", "/")[0].alias("project")
    handled = run.handled.withColumnRenamed("path", "source_file").groupBy(project).agg(F.count("*").alias("handled"))
    points = run.points.groupBy(project).agg(F.count("*").alias("points"))
    files = run.snapshot.withColumnRenamed("path", "source_file").groupBy(project).agg(F.count("*").alias("files"))
    return files.join(handled, "project", "left").join(points, "project", "left").select("project", "files", F.coalesce("handled", F.lit(0)).alias("handled"), "points")


_ORDERED = f"o AS (SELECT doc_id, ' ' || array_to_string(list_filter(flatten(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+'), lambda w: list_transform(string_split(regexp_replace(w, '(\\P{{Lu}})(\\p{{Lu}})', '\\1 \\2', 'g'), ' '), lambda x: lower(x)))), lambda t: octet_length(encode(t)) >= 2 AND t NOT IN ({_STOP})), ' ') || ' ' AS t FROM documents)"


@query(f"WITH {_ORDERED} SELECT doc_id FROM o WHERE (contains(t, ' und der ') OR contains(t, ' que ')) AND NOT contains(t, ' die ')")
def text_boolean(spark: SparkSession, d: str) -> DataFrame:
    """A phrase or a word, and not another."""
    return _index(spark, d).boolean('("und der" OR que) AND NOT die').select("doc_id")


@query(f"WITH {_ORDERED} SELECT doc_id FROM o WHERE contains(t, ' und ') AND contains(t, ' der ') AND NOT contains(t, ' ge ')")
def text_wanted(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).boolean("+und +der -ge die").select("doc_id")


@query(f"WITH {_ORDERED} SELECT doc_id FROM o WHERE NOT contains(t, ' und ') AND NOT contains(t, ' que ')")
def text_barred(spark: SparkSession, d: str) -> DataFrame:
    """Words that must not stand there: documents without any term are among the hits."""
    return _index(spark, d).boolean("NOT und AND NOT que").select("doc_id")


def _phrase(words: str) -> str:
    w = words.split()
    return f"len(list_filter(range(1, len(l) + 1), lambda i: l[i:i + {len(w) - 1}] = [{', '.join(repr(x) for x in w)}]))"


_LISTED = _ORDERED + ", l AS (SELECT doc_id, CASE WHEN trim(t) = '' THEN [] ELSE string_split(trim(t), ' ') END AS l FROM o)"
_PHRASES = ("und der", "que", "la le")


@query(
    f"WITH {_LISTED}, f AS (SELECT doc_id, len(l) AS dl, {_phrase('die')} AS no, {', '.join(f'{_phrase(p)} AS f{i}' for i, p in enumerate(_PHRASES))} FROM l), "
    f"s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS d{i}' for i in range(3))} FROM f), "
    f"r AS (SELECT doc_id, round({' + '.join(f'CASE WHEN d{i} > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) ELSE 0 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))' for i in range(3))}, 6) AS score FROM f, s WHERE no = 0 AND f0 + f1 + f2 > 0) "
    "SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100"
)
def phrase_topk(spark: SparkSession, d: str) -> DataFrame:
    """A top-100 report: phrases ranked as terms, over stored positions."""
    return _index(spark, d).ranked('("und der" OR que OR "la le") AND NOT die', 100).select("doc_id", "score")


_ENDS = {"signup": "running", "purchase": "succeeded", "error": "failed", "click": "cancelled", "view": "interrupted"}
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ENDS.items()) + " END"


@query(
    f"WITH j AS (SELECT user_id % 7 AS project, event_id AS job, {_STATE} AS state, ts FROM events), k AS (SELECT *, state <> 'running' AS ended, row_number() OVER (PARTITION BY project, state <> 'running' ORDER BY ts DESC, job DESC) AS n FROM j) "
    "SELECT project, job, state, CAST(row_number() OVER (PARTITION BY project ORDER BY ended, n) AS INTEGER) AS nth FROM k WHERE NOT ended OR n <= 50"
)
def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    state = F.element_at(F.create_map(*[F.lit(x) for kv in _ENDS.items() for x in kv]), F.col("event_type"))
    jobs = e.select((F.col("user_id") % 7).alias("project"), F.col("event_id").alias("job"), state.alias("state"), "ts")
    return catalog.recent_jobs(jobs, "project", "state", "ts", "job").drop("ts")


@query(
    "WITH r AS (SELECT event_type, event_id % 101 / 100.0::DOUBLE AS recall, CAST(floor(value) AS BIGINT) AS ms, event_id % 9 = 0 AS failed FROM events) SELECT event_type, count(*) AS queries, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS errors, "
    "round(avg(recall) FILTER (WHERE NOT failed), 6) AS recall_mean, min(recall) FILTER (WHERE NOT failed) AS recall_least, max(recall) FILTER (WHERE NOT failed) AS recall_most, "
    "CAST(sum(ms) FILTER (WHERE NOT failed) // count(ms) FILTER (WHERE NOT failed) AS BIGINT) AS millis_mean FROM r GROUP BY ALL"
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_type", "event_id", (F.col("event_id") % 101 / F.lit(100.0)).alias("recall"), F.floor("value").alias("ms"))
    return evaluate.run_summary(e, "recall", "ms", F.col("event_id") % 9 == 0, ["event_type"])


@query()
def writer_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of each user's writer: purchases end a job, all else are changes."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("project"), "ts", F.when(F.col("event_type") == "purchase", "done").otherwise("change").alias("kind"), F.col("event_type").alias("path"))
    return watch.jobs(e, 3_600_000)


@query(_knn(_COS, cols="query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(label AS VARCHAR), vec_id) AS INTEGER) AS at_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CAST(label AS VARCHAR), vec_id) AS INTEGER) AS at_file"))
def hits_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The places of hits in a browser ordered by score, and by file and line."""
    v, q = _vectors(spark, d)
    hits = dense.search(v, q).join(v.select("vec_id", F.col("label").cast("string").alias("source_file")), "vec_id").withColumn("start_line", F.col("vec_id"))
    place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(*collection.row_order(by, key="vec_id")))
    return hits.select("query_id", "vec_id", "score", place(True).alias("at_score"), place(False).alias("at_file"))


_LATER = "later AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN left(text, 200) || ' changed thing' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3)"


@query(
    f"WITH {_LATER}, {_tf('tf', 'later', 'doc_id')}, d AS (SELECT term_hash, count(*) AS df FROM tf GROUP BY ALL), s AS (SELECT (SELECT count(*) FROM later) AS n, (SELECT CAST(sum(tf) AS BIGINT) FROM tf) AS total) "
    "SELECT term_hash, df, n, total FROM d, s"
)
def bm25_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """Statistics after documents came, changed and went, from those before and the change alone."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    left = F.col("doc_id") % 10
    before = docs.where(left != 1)
    counts = stored.written(sparse.counted(before, "doc_id", "text"), "counts")
    stats = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.sum("n_tokens").alias("total"))
    gone = docs.where(left.isin(2, 3))
    fresh = docs.where(left.isin(1, 2)).withColumn("text", F.when(left == 2, F.concat(F.left("text", F.lit(200)), F.lit(" changed thing"))).otherwise(F.col("text")))
    df, size = sparse.shifted(sparse.listed(counts, "doc_id").groupBy("term_hash").agg(F.count("*").alias("df")), stats, sparse.frequencies(gone, "doc_id", "text"), sparse.frequencies(fresh, "doc_id", "text"), fresh.count() - gone.count(), "doc_id")
    return df.crossJoin(F.broadcast(size)).select("term_hash", "df", "n", "total")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL OR text = '' THEN 'rejected' WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'inserted' END AS outcome FROM documents WHERE doc_id % 3 <> 0 "
    "UNION ALL SELECT doc_id, 'superseded' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0 AND text <> '' UNION ALL SELECT doc_id, 'rejected' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0 AND (doc_id % 7 = 0 OR text IS NULL OR text = '')"
)
def write_results(spark: SparkSession, d: str) -> DataFrame:
    """What a write makes of each row; every fifth document is written twice, every seventh without a key."""
    docs = _t(spark, d, "documents").select("doc_id", "text").withColumn("id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    fresh = docs.where("doc_id % 3 <> 0").withColumn("seq", F.lit(2))
    fresh = fresh.union(fresh.where("doc_id % 5 = 0").withColumn("seq", F.lit(1)))
    return collection.written(docs.where("doc_id % 2 = 0"), fresh, F.col("text") != "", seq="seq").select("doc_id", "outcome")


@query("SELECT event_id, event_type, value FROM events WHERE event_id BETWEEN 1000 AND 1200 AND value > 10 OR event_id IN (5, 17, 400)")
def store_filter_files(spark: SparkSession, d: str) -> DataFrame:
    """A store's filter text against files laid out by range: those that can hold no such row aren't read."""
    events = stored.laid_out(_t(spark, d, "events").select("event_id", "event_type", "value"), stored.scratch(spark, "points"), ["event_id"], ("event_type",))
    return events.where(filters.store_filter("event_id BETWEEN 1000 AND 1200 AND value > 10 OR event_id IN (5, 17, 400)"))


@query(f"WITH {_tok('tok', 'documents', 'doc_id')}, n AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(max(tf) AS BIGINT) AS most FROM n GROUP BY ALL")
def postings_terms(spark: SparkSession, d: str) -> DataFrame:
    """What the stored index holds of each term."""
    return _index(spark, d).table.where("term_hash >= 0").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))

@query("SELECT page_id, left('key-' || page_id || '-secret', 8) AS key_id FROM pages WHERE page_id % 3 = 0")
def admitted_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").withColumn("key", F.concat(F.lit("key-"), F.col("page_id").cast("string"), F.lit("-secret")))
    asked = p.select("page_id", F.concat(F.when(F.col("page_id") % 6 == 1, "Basic ").otherwise("Bearer "), F.col("key")).alias("authorization"))
    return catalog.admitted(asked, p.where("page_id % 3 = 0").select(F.concat(F.lit(" "), F.col("key")).alias("key"))).select("page_id", "key_id")
