"""Text, identity and path functions on known cases."""

import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.functions import text as T
from quarry.operators import chunk, filters


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


TOKENS = [
    ("parseConfig", ["parse", "config"]), ("ParseConfig", ["parse", "config"]), ("HTTPServer", ["httpserver"]), ("parseURLPath", ["parse", "urlpath"]),
    ("load_config", ["load", "config"]), ("ABC_RAG_TEST", ["abc", "rag", "test"]), ("kebab-name", ["kebab", "name"]), ("foo.bar()", ["foo", "bar"]),
    ("the function returns", ["function", "returns"]), ("func main()", ["main"]), ("a b cd", ["cd"]), ("", []), ("éa É", ["éa", "é"]),
]


def test_tokens(spark):
    assert column(spark, [x for x, _ in TOKENS], T.tokenize) == [y for _, y in TOKENS]


def test_stop_words():
    assert len(set(T.STOP_WORDS)) == len(T.STOP_WORDS) > 140


def fnv32(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % 65536


def test_term_hash(spark):
    words = ["config", "parser", "é", "", "日本語", "x" * 300]
    assert column(spark, words, lambda c: T.term_hash("v")) == [fnv32(w) for w in words]


def test_ids(spark):
    names = ["a:b:1", "", "é"]
    assert column(spark, names, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    for key in ("k", "long" * 30):
        assert column(spark, names, lambda c, key=key: ids.keyed_hash(c, key)) == [hmac.new(key.encode(), n.encode(), hashlib.sha256).hexdigest() for n in names]
    assert column(spark, ["", "a", None], ids.fnv64) == ["cbf29ce484222325", "af63dc4c8601ec8c", None]
    assert column(spark, ["", "hello"], ids.content_hash) == [hashlib.sha256(x).hexdigest() for x in (b"", b"hello")]


def test_names(spark):
    paths = {"/my-app": "my-app", "/projects/app": "app-projects", "/repos/api-server": "api-server-repos", "/home/user/FooBar_Baz": "foobar-baz", "/test/test": "test-test"}
    assert column(spark, list(paths), T.project_name) == list(paths.values())
    assert column(spark, ["My Project.App", "--x--", "a__b"], T.slug) == ["my-project-app", "x", "a-b"]
    assert column(spark, ["a-b-c-10", "a-b", "7"], T.strip_number) == ["a-b-c", "a-b", "7"]
    assert T.free_name("m", {"m"}) == "m-2" and T.free_name("m", {"m", "m-2"}) == "m-3" and T.free_name("m", None) == "m" and T.free_name("m-2", {"m-2", "m"}) == "m-3"
    with pytest.raises(ValueError):
        T.free_name("m", {"m", *(f"m-{i}" for i in range(200))})
    assert column(spark, ["C:\\A\\b\\", "/x/"], T.normal_path) == ["c:/a/b", "/x"]


def test_small_functions(spark):
    assert column(spark, ["abcdefghij", "short", "", None], T.mask_key) == ["abcd...ghij", "***", "(unset)", "(unset)"]
    assert column(spark, ["7", "x", "-3", None], T.positive_or_one) == [7, 1, 1, 1]
    assert column(spark, ["a \n b", "x" * 100], T.one_line) == ["a b", "x" * 96 + "..."]
    assert column(spark, [0.7, 0.65, 0.5, 0.1], T.score_band, "double") == ["high", "high", "mid", "low"]
    row = spark.range(1).select(T.weighted_text(F.lit("f"), F.lit("f"), F.lit("x.go"), F.lit("body"))).first()[0]
    assert row == "f f f x.go x.go body"


GLOBS = [
    ("*.log", "a.log", True), ("*.log", "d/a.log", False), ("**/*.go", "a/b/c.go", True), ("**/*.go", "c.go", True), ("**/*.go", "c.got", False), ("src/**", "src/a/b", True), ("src/**", "src", True), ("src/**", "lib/a", False),
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/xb", False), ("test*", "testing", True), ("a*c", "abbc", True), ("a*c", "ab/c", False), ("a.b", "axb", False), ("**", "x/y", True), ("**/x/**", "x", True), ("**/x/**", "q/x/z", True),
]


def test_globs(spark):
    for pattern, path, want in GLOBS:
        got = spark.range(1).select(filters.glob(F.lit(path), pattern), F.lit(path).rlike(filters.glob_regex(pattern))).first()
        assert tuple(got) == (want, want), (pattern, path)


IGNORES = [
    (["*.log"], "a.log", True), (["*.log"], "d/a.log", True), (["*.log", "!important.log"], "important.log", False), (["!important.log", "*.log"], "important.log", True), (["node_modules/"], "node_modules/x.js", True),
    (["node_modules/"], "a/node_modules/x.js", True), (["node_modules/"], "node_modules", False), (["/build"], "build/x", True), (["/build"], "a/build/x", False), (["a/b"], "a/b/c", True), (["a/b"], "x/a/b", False), ([".env"], ".env", True), (["# no", ""], "a", False), (["**/t/*.x"], "q/t/a.x", True),
]


def test_ignore_rules(spark):
    for rules, path, want in IGNORES:
        assert spark.range(1).select(filters.ignored(F.lit(path), rules)).first()[0] is want, (rules, path)
    nested = {"": ["*.log"], "keep": ["!*.log"], "keep/deep": ["x.log"]}
    for path, want in (("a.log", True), ("keep/a.log", False), ("keep/deep/x.log", True), ("keep/deep/y.log", False), ("keeper/a.log", True)):
        assert spark.range(1).select(filters.nested_ignored(F.lit(path), nested)).first()[0] is want, path


def test_paths(spark):
    assert column(spark, ["main.go", "Makefile", "x.PNG", "a.b/readme", "Dockerfile", ".env", "x/y.Rs"], filters.source_file) == [True, True, False, False, True, True, True]
    assert column(spark, ["a/node_modules/b.js", "src/a.go", ".git/x", "bin", "x/bin/y", "./a.go"], filters.skipped_folder) == [True, False, True, False, True, False]
    assert column(spark, ["a/B.py", "Dockerfile", "x.json", "y.hxx", "Makefile"], chunk.language_of) == ["python", "dockerfile", None, "cpp", None]
    for pattern, path, want in (("**/api/**", "x/api/y.go", True), ("*.go", "a.go", True), ("*.go", "d/a.go", False), ("API", "x/api/y", True), ("", "x", True)):
        assert spark.range(1).select(filters.path_filter(F.lit(path), pattern)).first()[0] is want
