"""Chunkers by name, and a table function that applies the one that a file's language asks for.

``register`` adds a chunker: a function of (text, path, language) that gives (language, symbol,
name, start_line, end_line, part, content) rows. ``choose`` binds languages to chunkers; others
take ``definitions``. In SQL: ``SELECT f.path, c.* FROM files f, LATERAL chunk_text(f.path, f.content) c``,
with a chunker's name as a third argument to take that one for every file. The name is checked
when the query is analyzed. Texts reach the function as Arrow batches, file by file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import chunk

Chunker = Callable[[str, str, str | None], list[tuple]]
SCHEMA = StructType()
for _name, _type in (("language", "string"), ("symbol", "string"), ("name", "string"), ("start_line", "integer"), ("end_line", "integer"), ("part", "integer"), ("chunk", "string")):
    SCHEMA.add(_name, _type)


def _lines(text: str, path: str, language: str | None) -> list[tuple]:
    base = path.rsplit("/", 1)[-1]
    return [(language or "text", "chunk", f"{base}:{a}-{b}", a, b, part, content) for a, b, part, content in chunk.pack_lines(text)]


CHUNKERS: dict[str, Chunker] = {"definitions": chunk.chunk_file, "lines": _lines}
BY_LANGUAGE: dict[str, str] = {}


def register(name: str, chunker: Chunker) -> None:
    """Adds a chunker; a name that is taken is an error."""
    if name in CHUNKERS:
        raise ValueError(f"chunker {name} exists")
    CHUNKERS[name] = chunker


def choose(language: str, name: str) -> None:
    """Files of a language take this chunker from now on."""
    if name not in CHUNKERS:
        raise KeyError(name)
    BY_LANGUAGE[language] = name


def language_of(path: str) -> str | None:
    """As ``chunk.language_of`` tells it of a column."""
    base = path.rsplit("/", 1)[-1].lower()
    return chunk.LANGUAGES.get(base.rpartition(".")[2]) if "." in base else None if base != "dockerfile" else "dockerfile"


def function():  # noqa: ANN201
    """The table function over the chunkers known now."""
    known, by_language = dict(CHUNKERS), dict(BY_LANGUAGE)

    class ChunkText:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, chunker: AnalyzeArgument | None = None) -> AnalyzeResult:
            for what, arg in (("path", path), ("content", content)):
                if not isinstance(arg.dataType, StringType):
                    raise ValueError(f"chunk_text: {what} must be a string")
            if chunker is not None and (not chunker.isConstantExpression or chunker.value not in known):
                raise ValueError(f"chunk_text: {chunker.value!r} is no chunker; there are {', '.join(sorted(known))}")
            return AnalyzeResult(SCHEMA)

        def eval(self, path: str, content: str, chunker: str | None = None) -> Iterator[tuple]:
            language = language_of(path or "")
            yield from known[chunker or by_language.get(language or "", "definitions")](content or "", path or "", language)

    return udtf(ChunkText, useArrow=True)


def applied(files: DataFrame, chunker: str | None = None, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, chunk columns) of every file, through the table function."""
    spark: SparkSession = files.sparkSession
    spark.udtf.register("chunk_text", function())
    return spark.sql(
        f"SELECT f.path, c.* FROM {{files}} f, LATERAL chunk_text(f.path, f.content{', {chunker}' if chunker else ''}) c",
        files=files.select(files[path_col].alias("path"), files[text_col].alias("content")), **({"chunker": chunker} if chunker else {}),
    )
