"""A corpus pipeline over ``documents``: rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads
it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import packing, quality, simhash_similar, substring, toxicity
from quarry.llm.common import table, written
from quarry.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Toxicity scores from here on are rejected.
TOXIC = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and every learned rule; rules are learned from labelled ``documents``."""
    rules = quality.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents under the toxicity threshold; the model is learned from labelled rows of ``documents``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of similarity 0.8 or more over five-word shingles."""
    return simhash_similar.keep_first(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of texts; documents stay, if need be with an empty text."""
    out = substring.cut_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into windows of 2048 ids: a row for each piece."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), most_padding=1 / 64)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: Learned rules, hashing and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what comes between them is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
