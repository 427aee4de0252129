"""Queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .tokens import public_path

#: The window count of op10 rises by this part at most; beyond it documents are cut.
MOST_PADDING = 1 / 64
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from ids outside the held-out fold; every text is scored."""
    from . import toxicity

    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids, each a row of the padded id matrix with its segment columns."""
    from . import token_output

    return token_output.windows(table(spark, sf_dir, "documents"), public_path(BYTE_BPE))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    rules = quality.learned(docs, table(spark, sf_dir, "labels"))
    out = quality.judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_path(WORD_BPE), digest=True)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_path(BYTE_BPE), most_padding=MOST_PADDING)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import config_lp

    return config_lp.pack(table(spark, sf_dir, "documents"), public_path(BYTE_BPE))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ALL = (
    op1_toxicity, op2_simhash, op3_html_extraction, op4_substring, op5_token_output, op6_lm_score, op7_quality, op8_bpe,
    op9_embedding_dedup, op10_packing, op11_best_fit_packing, op12_whitening, op13_prefix_trie,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

#: The trie in SQL: crc32 by a table made from its polynomial, prefixes as digests of the turns so far.
TRIE_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), lens AS (
  SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id
), hashed AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h
  FROM lens, crc
), convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS len
  FROM hashed c LEFT JOIN lens b ON b.conv_id = c.base
), turns AS (
  SELECT c.conv_id, o.pos AS depth, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.taken
  UNION ALL
  SELECT c.conv_id, c.taken + o.pos - c.h, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), steps AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS path, '' AS above, 0::BIGINT AS bytes FROM convs
  UNION ALL
  SELECT s.conv_id, t.depth, sha256(s.path || ':' || strlen(t.role) || ':' || t.role || t.text), s.path, strlen(t.text)
  FROM steps s JOIN turns t ON t.conv_id = s.conv_id AND t.depth = s.depth + 1
), nodes AS (
  SELECT depth, path, any_value(above) AS above, min(s.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(CASE WHEN len = depth THEN s.conv_id::VARCHAR END, ',' ORDER BY s.conv_id), '') AS ends
  FROM steps s JOIN convs c ON c.conv_id = s.conv_id GROUP BY depth, path
), kids AS (
  SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), pairs AS (
  SELECT DISTINCT a.depth, a.path, b.depth AS d, b.path AS p FROM steps a JOIN steps b ON b.conv_id = a.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT q.depth, q.path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens
  FROM pairs q JOIN nodes x ON x.depth = q.d AND x.path = q.p LEFT JOIN kids k ON k.depth = q.d AND k.path = q.p GROUP BY ALL
)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.depth = x.depth - 1 AND y.path = x.above LEFT JOIN kids k ON k.depth = x.depth AND k.path = x.path
JOIN sums s ON s.depth = x.depth AND s.path = x.path
"""

ORACLES: dict[str, str] = {"op13_prefix_trie": TRIE_SQL}
