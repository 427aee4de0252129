"""Results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_line(score: Column, file: Column, start: Column, end: Column, name: Column) -> Column:
    return F.concat(F.lit("[score "), F.format_string("%.3f", score), F.lit("] "), file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ("), name, F.lit(")"))


def context(hits: DataFrame, line: Column, content: Column, query_col: str = "query_id") -> DataFrame:
    """One text for each query: hits by rank, a heading line and the content of each. Hits are a top-k, so bounded."""
    rows = hits.select(query_col, F.struct("rank", F.concat(line, F.lit("\n"), content).alias("text")).alias("r"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), "\n\n")
    return rows.groupBy(query_col).agg(ordered.alias("context"))


def quoted(text: Column) -> Column:
    """In double quotes, with quotes, backslashes and line breaks escaped."""
    out = text
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _known(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def fenced(language: Column, content: Column) -> Column:
    return F.concat(F.lit("```"), _known(language), F.lit("\n"), _known(content), F.lit("\n```\n"))


def place(file: Column, name: Column, symbol: Column, start: Column, end: Column) -> Column:
    """The lines that say where a chunk stands."""
    shown = F.when(_known(file) == "", F.lit("(unknown)")).otherwise(file)
    return F.concat(F.lit("File: "), shown, F.lit("\nSymbol: "), _known(name), F.lit(" ("), _known(symbol), F.lit(")\nLines: "), _known(start), F.lit("-"), _known(end), F.lit("\n"))


def results(hits: DataFrame, queries: DataFrame, query_col: str = "query_id", text_col: str = "text", project_col: str = "project") -> DataFrame:
    """(query, results): for each query its hits (rank, score, source_file, symbol, name, start_line, end_line, language, content) as text; queries without hits say so. Hits are a top-k, so bounded."""
    score = F.format_string("%.3f", F.round("score", 3))
    one = F.concat(
        F.lit("--- Result "), F.col("rank").cast("string"), F.lit(" (score: "), score, F.lit(") ---\n"),
        place(F.col("source_file"), F.col("name"), F.col("symbol"), F.col("start_line"), F.col("end_line")), F.lit("\n"), fenced(F.col("language"), F.col("content")), F.lit("\n"),
    )
    listed = hits.groupBy(query_col).agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("one")))), lambda r: r["one"]), "").alias("_all"))
    n = F.coalesce("_n", F.lit(0))
    head = F.concat(F.lit("Found "), n.cast("string"), F.lit(" results for "), quoted(_known(F.col(text_col))), F.lit(" in project "), quoted(_known(F.col(project_col))), F.lit(":\n\n"))
    none = F.lit("(no matches — try a different query or verify the project is indexed)\n")
    return queries.join(listed, query_col, "left").select(query_col, F.concat(head, F.when(n > 0, F.col("_all")).otherwise(none)).alias("results"))
