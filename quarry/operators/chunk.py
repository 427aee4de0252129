"""Splitting files into chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language by extension.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "rs": "rust", "java": "java", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "hh": "cpp", "hxx": "cpp",
    "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "sql": "sql", "swift": "swift", "kt": "kotlin", "scala": "scala", "lua": "lua",
    "proto": "protobuf", "css": "css", "scss": "css", "less": "css", "html": "html", "tf": "hcl", "hcl": "hcl", "yaml": "yaml", "yml": "yaml",
}

MOST_BYTES, MOST_LINES, BYTES_PER_TOKEN = 3000, 60, 3


def language_of(path: Column) -> Column:
    """Language by extension, then by name; null where there is none."""
    base = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.regexp_extract(base, r"\.([^.]*)$", 1)), F.when(base == "dockerfile", F.lit("dockerfile")))


def by_lines(docs: DataFrame, id_col: str, text_col: str, most: int = MOST_LINES, overlap: int = 0) -> DataFrame:
    """Chunks of at most ``most`` lines: id, chunk_no, start_line, end_line, content; each begins with the last ``overlap`` lines of the one before."""
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be shorter than a chunk")
    lines = docs.select(id_col, F.split(text_col, "\n").alias("_lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_lines") - 1 - overlap), F.lit(most - overlap))
    out = lines.select(id_col, "_lines", F.posexplode(starts).alias("chunk_no", "_at"))
    part = F.slice("_lines", F.col("_at") + 1, most)
    return out.select(id_col, "chunk_no", (F.col("_at") + 1).alias("start_line"), (F.col("_at") + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("content"))


def pack_lines(text: str, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES, truncate: bool = False) -> list[tuple[int, int, int, str]]:
    """Greedy chunks of whole lines under both caps: (start, end, part, content).

    A line over the byte cap alone is cut at characters into parts (or, with
    ``truncate``, loses its end).
    """
    out: list[tuple[int, int, int, str]] = []
    held: list[str] = []
    start = size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append((start + 1, start + len(held), 0, "\n".join(held)))
        held, size = [], 0

    for i, line in enumerate(text.split("\n")):
        raw = line.encode()
        if len(raw) > most_bytes:
            flush()
            part = 0
            while raw:
                cut = min(most_bytes, len(raw))
                while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                    cut -= 1
                out.append((i + 1, i + 1, part, raw[:cut].decode()))
                raw, part = raw[cut:], part + 1
                if truncate:
                    break
            continue
        if held and (size + len(raw) + 1 > most_bytes or len(held) >= most_lines):
            flush()
        if not held:
            start, size = i, -1
        held.append(line)
        size += len(raw) + 1
    flush()
    return out


#: Bytes of text that a task cuts at a time, and rows that it holds at most.
SLICE, HELD_ROWS = 4_000_000, 20_000


def capped(docs: DataFrame, id_col: str, text_col: str, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> DataFrame:
    """``pack_lines`` of every document: files are independent, so each task folds its own, some megabytes at a time."""
    kind = dict(docs.dtypes)[id_col]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = [id_col, "chunk_no", "start_line", "end_line", "part", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(0).type

            def made(at: list[int], rows: list[tuple], batch: pa.RecordBatch = batch, id_type: pa.DataType = id_type) -> pa.RecordBatch:
                named = batch.column(0).take(pa.array(at, pa.int64())).cast(id_type)
                return pa.RecordBatch.from_arrays([named, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names)

            at, rows, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                for k, c in enumerate(pack_lines(text.as_py() or "", most_bytes, most_lines)):
                    at.append(i)
                    rows.append((k, *c))
                    size += len(c[3])
                    if size >= SLICE or len(rows) >= HELD_ROWS:
                        yield made(at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield made(at, rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk_no int, start_line int, end_line int, part int, content string")


def split_oversized(docs: DataFrame, id_col: str, text_col: str, most_tokens: int) -> DataFrame:
    """Chunks over the token budget (three bytes each) split at lines, long lines at characters."""
    return capped(docs, id_col, text_col, most_tokens * BYTES_PER_TOKEN, 1 << 30)


def token_budget(override: Column, context: Column) -> Column:
    """The override, else 400 without a known context, else 80 % of it between 128 and 2000."""
    return F.when(override > 0, override).when(F.coalesce(context, F.lit(0)) <= 0, F.lit(400)).otherwise(F.greatest(F.lit(128), F.least(F.lit(2000), F.floor(context * 0.8).cast("int"))))


_STARTS = {
    "go": r"^(?P<kind>func|type)\s+(?:\([^)]*\)\s*)?(?P<name>\w+)",
    "javascript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<kind>function\*?|class|const|let|var)\s+(?P<name>[\w$]+)",
    "typescript": r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?P<kind>function|class|interface|type)\s+(?P<name>[\w$]+)",
    "rust": r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?P<kind>fn|struct|enum|trait|impl)(?:<[^>]*>)?\s+(?P<name>\w+)",
    "java": r"^(?:(?:public|private|protected|abstract|final|static)\s+)*(?P<kind>class|interface)\s+(?P<name>\w+)",
    "csharp": r"^(?:(?:public|private|internal|abstract|sealed|static|partial)\s+)*(?P<kind>class|interface)\s+(?P<name>\w+)",
    "cpp": r"^(?:(?P<kind>class|struct)\s+(?P<name>\w+)|[\w:<>*&\s]+?\s[*&]?(?P<name2>[\w:~]+)\s*\([^;]*$)",
    "ruby": r"^(?P<kind>def|class|module)\s+(?P<name>[\w.:?!]+)",
    "php": r"^(?:(?:abstract|final)\s+)?(?P<kind>function|class|interface)\s+(?P<name>\w+)",
    "bash": r"^(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?",
    "sql": r"(?i)^(?P<kind>create|insert|select)\b(?:\s+(?:or\s+replace\s+)?(?:table|view|function|index|into)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+))?",
    "swift": r"^(?:public\s+)?(?P<kind>func|class|struct|protocol)\s+(?P<name>\w+)",
    "kotlin": r"^(?:(?:public|private|open|data)\s+)*(?P<kind>fun|class|object)\s+(?P<name>\w+)",
    "scala": r"^(?:case\s+)?(?P<kind>def|class|object|trait)\s+(?P<name>\w+)",
    "lua": r"^(?:local\s+)?(?P<kind>function)\s+(?P<name>[\w.:]+)",
    "protobuf": r"^(?P<kind>message|service|enum)\s+(?P<name>\w+)",
    "css": r"^(?P<name>[^\s{}@][^{}]*)\{",
    "hcl": r"^(?P<kind>resource|data|variable|module|output|provider|locals|terraform)\b",
    "dockerfile": r"(?i)^(?P<kind>from|run|env|cmd|copy|add)\b",
}


_QUOTED, _CHAR, _BLOCK, _SLASHES = r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\\n])*'?", r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"
_HEREDOC = r"<<[-~]?(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=tag)\b|\Z)"
_HASH = r"(?<![$\w{])#[^\n]*"
#: What is no code in each language: comments and literals, the longer forms first.
_NO_CODE = {
    x: re.compile("|".join(parts), re.S | re.M)
    for names, parts in (
        ("go", (_BLOCK, _SLASHES, r"`[^`]*`?", _QUOTED, _CHAR)),
        ("javascript typescript", (_BLOCK, _SLASHES, r"`(?:\\.|[^`\\])*`?", _QUOTED, _CHAR)),
        ("java kotlin scala swift", (_BLOCK, _SLASHES, r'""".*?(?:"""|\Z)', _QUOTED, _CHAR)),
        ("rust", (_BLOCK, _SLASHES, r'\br(?P<n>#*)".*?(?:"(?P=n)|\Z)', _QUOTED, r"'(?:\\[^\n']+|[^'\\\n])'")),
        ("csharp", (_BLOCK, _SLASHES, r'\$?@\$?"(?:""|[^"])*"?', _QUOTED, _CHAR)),
        ("cpp protobuf", (_BLOCK, _SLASHES, r'\bR"(?P<d>[^(\s]*)\(.*?(?:\)(?P=d)"|\Z)', _QUOTED, _CHAR)),
        ("php", (_BLOCK, _SLASHES, _HASH, r"<<<['\"]?(?P<tag>\w+)['\"]?\n.*?(?:^[ \t]*(?P=tag)\b|\Z)", _QUOTED, r"'(?:\\.|[^'\\])*'?")),
        ("css", (_BLOCK, _QUOTED, _CHAR)),
        ("bash hcl", (_HEREDOC, _HASH, _QUOTED, r"'[^']*'?")),
        ("ruby", (r"^=begin\b.*?(?:^=end\b|\Z)", _HEREDOC, _HASH, _QUOTED, r"'(?:\\.|[^'\\])*'?")),
        ("lua", (r"--\[(?P<c>=*)\[.*?(?:\](?P=c)\]|\Z)", r"--[^\n]*", r"\[(?P<s>=*)\[.*?(?:\](?P=s)\]|\Z)", _QUOTED, _CHAR)),
        ("sql", (_BLOCK, r"--[^\n]*", r"\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z)", r"'(?:''|[^'])*'?", r'"[^"]*"?')),
    )
    for x in names.split()
}
#: Where a line's end may close a definition that opened no bracket.
_BY_LINE = frozenset("go javascript typescript kotlin scala swift hcl".split())
_GOES_ON_AFTER, _GOES_ON_BEFORE = re.compile(r"[,=+\-*/&|.<(?:]\s*$|=>\s*$"), re.compile(r"\s*[{.?:|&=+]")
#: Words that open and close what ``end`` closes.
_OPENS = {
    "ruby": re.compile(r"^[ \t]*(?:class|module|if|unless|while|until|case|for|begin|def(?![^\n]*\)?[ \t]=[ \t]))\b|(?<=[=(,])[ \t]*(?:if|unless|case|begin|while)\b|\bdo\b(?=[ \t]*+(?:\|[^|\n]*\|)?[ \t]*+$)|^[\w@, \t]+=[ \t]*+(?:if|case|begin)\b", re.M),
    "lua": re.compile(r"\b(?:function|do|repeat|if)\b"),
}
_CLOSES = {"ruby": re.compile(r"(?<![\w.:@])end\b(?![?!:])"), "lua": re.compile(r"\b(?:end|until)\b")}


def code_only(text: str, language: str) -> str:
    """The text with comments, strings and heredocs made blank, each line where it was; one pass."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return _NO_CODE[language].sub(blank, text) if language in _NO_CODE else text


def _depths(code: str, language: str) -> list[int]:
    """Open brackets (or blocks) before each line."""
    out, depth = [], 0
    for line in code.split("\n"):
        out.append(depth)
        if language in _OPENS:
            line = line.strip()  # noqa: PLW2901
            depth += len(_OPENS[language].findall(line)) - len(_CLOSES[language].findall(line))
        else:
            depth += sum(line.count(c) for c in "{([") - sum(line.count(c) for c in "})]")
        depth = max(0, depth)
    return [*out, depth]


def _last_line(lines: list[str], depths: list[int], first: int, language: str) -> int:
    """The line (from 0) that ends the definition begun on ``first``, at depth 0."""
    for i in range(first, len(lines)):
        if depths[i + 1]:
            continue
        line = lines[i].rstrip()
        if language in _OPENS or line.endswith(";") or "}" in line:
            return i
        after = next((x for x in lines[i + 1 :] if x.strip()), "")
        if language in _BY_LINE and line and not _GOES_ON_AFTER.search(line) and not _GOES_ON_BEFORE.match(after):
            return i
    return len(lines) - 1


def definitions(text: str, language: str | None) -> list[tuple[str, str, int, int]]:
    """Top-level definitions: (kind, name, first line, last line).

    Python is parsed. Other languages are scanned once: comments, strings and heredocs are
    blanked, brackets (in Ruby and Lua the words that ``end`` closes) are counted, and a
    definition goes from where its beginning is read outside all of them to the bracket,
    semicolon or line that closes it. SQL statements end at their semicolon, a Dockerfile's
    instructions at a line that isn't continued. Unparsable or without any: empty.
    """
    lines = text.split("\n")
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        return [("class" if isinstance(n, ast.ClassDef) else "function", n.name, min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno) for n in tree.body if isinstance(n, kinds)]
    pattern = _STARTS.get(language or "")
    if not pattern:
        return []
    code = code_only(text, language).split("\n")
    depths = _depths("\n".join(code), language)
    out, i = [], 0
    while i < len(lines):
        m = re.match(pattern, lines[i]) if depths[i] == 0 and code[i].strip() else None
        if m is None:
            i += 1
            continue
        if language == "dockerfile":
            end = next((j for j in range(i, len(lines)) if not lines[j].rstrip().endswith("\\")), len(lines) - 1)
        elif language == "sql":
            end = next((j for j in range(i, len(lines)) if depths[j + 1] == 0 and code[j].rstrip().endswith(";")), len(lines) - 1)
        else:
            end = _last_line(code, depths, i, language)
        while end > i and not lines[end].strip():
            end -= 1
        g = m.groupdict()
        out.append((g.get("kind") or "definition", (g.get("name") or g.get("name2") or "").strip(), i + 1, end + 1))
        i = end + 1
    return out


def defined(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, language, symbol, name, start_line, end_line): the definitions of every file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, lang, *d) for p, t, lang in zip(f[path_col], f[text_col], f["_language"], strict=True) for d in definitions(t or "", lang)]
            yield pd.DataFrame(rows, columns=[path_col, "language", "symbol", "name", "start_line", "end_line"])

    chosen = files.select(path_col, text_col, language_of(F.col(path_col)).alias("_language"))
    return chosen.mapInPandas(run, f"{path_col} string, language string, symbol string, name string, start_line int, end_line int")


def chunk_file(text: str, path: str, language: str | None) -> list[tuple[str, str, str, int, int, int, str]]:
    """(language, symbol, name, start, end, part, content): definitions, or packed lines where there are none."""
    base = path.rsplit("/", 1)[-1]
    lines, out = text.split("\n"), []
    for kind, name, a, b in definitions(text, language):
        parts = pack_lines("\n".join(lines[a - 1 : b]), most_lines=1 << 30)
        for k, (s, e, part, content) in enumerate(parts):
            out.append((language, kind, f"{name} (part {k + 1})" if len(parts) > 1 else name, a + s - 1, a + e - 1, part, content))
    if out:
        return out
    kind = language or (base.rsplit(".", 1)[-1].lower() if "." in base else "text")
    return [(kind, "chunk", f"{base}:{s}-{e}", s, e, part, content) for s, e, part, content in pack_lines(text)]


def chunks(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Every file as chunks, with ``path_col`` kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *c) for p, t, lang in zip(f[path_col], f[text_col], f["_language"], strict=True) for c in chunk_file(t or "", p, lang)]
            yield pd.DataFrame(rows, columns=[path_col, "language", "symbol", "name", "start_line", "end_line", "part", "chunk"])

    chosen = files.select(path_col, text_col, language_of(F.col(path_col)).alias("_language"))
    return chosen.mapInPandas(run, f"{path_col} string, language string, symbol string, name string, start_line int, end_line int, part int, chunk string")
