import random

import pytest
from conftest_rows import DOCS, rows_of


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, special tokens, odd spaces, repeated rows, one very long text."""
    r = random.Random(5)
    long = " ".join(r.choice(["the", "Foo's", "bar,", "naïve", "42", "😀", "x" * 30]) for _ in range(20_000))
    return [
        None, "", " ", "\n\n\t", "a", "Hello  World x　y", "x<|endoftext|>y <|startoftext|> z", "It's we'll 'S 123,456",
        "é ́ é", "ΣΙΣ Σ", "same text here", "same text here", long, "\x1c\x1d\x85 z w", "'", "' s 't '", "   lead and trail   ",
    ]


@pytest.fixture
def odd_docs(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts), DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd_docs):
    """Extra columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    out = odd_docs
    for c in ("ids", "n_tokens", "words", "anchor", "score", "fingerprint", "component_id", "start", "kept", "label", "held_out", "n_removed", "_doc", "_at", "doc", "at", "id", "row", "rule", "n_words", "_row", "_words", "h", "c", "node", "uid"):
        out = out.withColumn(c, F.lit("clash"))
    return out
