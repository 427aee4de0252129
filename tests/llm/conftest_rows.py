import os

#: Tables of the next larger size than those of the ``sf`` fixture.
MEDIUM = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
