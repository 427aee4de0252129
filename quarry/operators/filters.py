"""Path and chunk filters compiled to Column predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that are never read (also every name that begins with a dot).
SKIPPED_FOLDERS = ".git .hg .svn node_modules vendor dist build target __pycache__ .venv venv .idea .vscode bin".split()

#: Extensions of files that are read.
SOURCE_EXTENSIONS = (
    "go py js jsx mjs cjs ts tsx rs java cs cpp cc cxx hpp h hh hxx rb php sh bash sql md rst txt json yaml yml toml ini cfg "
    "tf hcl dockerfile proto graphql gql html css scss less xml svg lua r dart swift kt scala clj ex exs erl hs ml vim ps1 "
    "bat cmd makefile cmake env gitignore editorconfig"
).split()

#: Whole file names that are read.
SOURCE_NAMES = "dockerfile makefile rakefile gemfile brewfile procfile .dockerignore .gitignore .npmignore .editorconfig .env".split()


def skipped_folder(path: Column) -> Column:
    """Whether a folder on the way to the file (not the file itself) is one never read."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda s: s.isin(*SKIPPED_FOLDERS) | (s.startswith(".") & ~s.isin(".", "..")))


def source_file(path: Column) -> Column:
    base = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.regexp_extract(base, r"\.([^.]*)$", 1).isin(*SOURCE_EXTENSIONS) | base.isin(*SOURCE_NAMES)


def glob_regex(pattern: str) -> str:
    """An anchored Java regex: ``**`` is any number of segments, ``*`` stays within one, all else is literal."""
    parts = pattern.replace("\\", "/").split("/")
    out, bare = "", False  # bare: no separator is due before the next part
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            if last:
                out += ".*" if i == 0 or bare else "(?:/.*)?"
            else:
                out += "(?:.*/)?" if i == 0 or bare else "/(?:.*/)?"
                bare = True
            continue
        out += ("" if i == 0 or bare else "/") + "[^/]*".join(re.escape(x) for x in part.split("*"))
        bare = False
    return f"(?s)^{out}$"


def glob(path: Column, pattern: str) -> Column:
    """A glob predicate; ``**/*.ext`` becomes a suffix test that a scan can take over."""
    plain = re.fullmatch(r"\*\*/\*(\.[^*/]+)", pattern)
    return path.endswith(plain[1]) if plain else path.rlike(glob_regex(pattern))


def any_glob(path: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob(path, p)
    return out


def pattern_filter(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Any include (or none given), and no exclude."""
    include = list(include)
    return (any_glob(path, include) if include else F.lit(True)) & ~any_glob(path, exclude)


def _ignore_regex(rule: str) -> tuple[str, bool]:
    """Java regex of one ignore rule and whether it takes paths back in."""
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folder_only = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    body = glob_regex(rule)[5:-1]
    head = "^" if anchored else "(?:^|.*/)"
    return f"(?s)^(?:{head}{body}){'/.+' if folder_only else '(?:/.*)?'}$", negated


def ignored(path: Column, rules: Iterable[str]) -> Column:
    """Whether ignore rules hide a file: the last rule that matches decides; a rule on a folder hides what is in it."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()  # noqa: PLW2901
        if not rule or rule.startswith("#"):
            continue
        regex, negated = _ignore_regex(rule)
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def nested_ignored(path: Column, by_folder: dict[str, list[str]]) -> Column:
    """Ignore rules of several folders ('' is the root); deeper folders decide over higher ones."""
    out = F.lit(False)
    for folder in sorted(by_folder, key=lambda f: (f.count("/") + bool(f), f)):
        inside = path if not folder else F.when(path.startswith(f"{folder}/"), F.substring(path, len(folder) + 2, 1_000_000))
        for rule in by_folder[folder]:
            if rule.strip() and not rule.startswith("#"):
                regex, negated = _ignore_regex(rule.rstrip())
                out = F.when(F.coalesce(inside.rlike(regex), F.lit(False)), F.lit(not negated)).otherwise(out)
    return out


def path_filter(path: Column, pattern: str) -> Column:
    """A browser's path box: with ``**`` a substring, with wildcards a glob, else a substring in any case."""
    if not pattern:
        return F.lit(True)
    if "**" in pattern:
        return path.contains(pattern.replace("*", "").strip("/"))
    if any(c in pattern for c in "*?["):
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) if c not in "[]^-" else c for c in pattern)
        return path.rlike(f"^{body}$")
    return F.contains(F.lower(path), F.lower(F.lit(pattern)))


def chunk_filter(
    keyword: str = "", path: str = "", language: str = "", symbol: str = "", least: int = 0, most: int = 0,
    content_col: str = "content", file_col: str = "source_file", symbol_col: str = "symbol", name_col: str = "name", language_col: str = "language",
) -> Column:
    """All given conditions; sizes are bytes, 0 is no bound."""
    out = F.lit(True)
    if keyword:
        out = out & F.contains(F.lower(F.concat_ws("\n", content_col, file_col, symbol_col, name_col)), F.lower(F.lit(keyword)))
    if path:
        out = out & path_filter(F.col(file_col), path)
    if language:
        out = out & (F.lower(F.col(language_col)) == language.lower())
    if symbol:
        out = out & (F.lower(F.col(symbol_col)) == symbol.lower())
    size = F.octet_length(F.col(content_col))
    if least > 0:
        out = out & (size >= least)
    if most > 0:
        out = out & (size <= most)
    return out


def must(conditions: dict[str, object]) -> Column:
    """Exact matches on columns, all of them."""
    out = F.lit(True)
    for key, value in conditions.items():
        out = out & (F.col(key) == F.lit(value))
    return out


_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<op>&&|\|\||==|!=|<>|<=|>=|[=<>!(),])|(?P<word>[A-Za-z_][\w.]*))')


class _Filter:
    """Recursive descent over: or := and (OR and)*; and := not (AND not)*; not := [NOT] ('(' or ')' | test)."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"filter {text!r}: unexpected {text[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next(self, *wanted: str) -> str | None:
        """The next token if it is one of these operators or words (in any case)."""
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind in ("op", "word") and value.lower() in wanted:
                self.at += 1
                return value.lower()
        return None

    def take(self, *kinds: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise ValueError(f"filter {self.text!r}: a {' or '.join(kinds)} is missing")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Column:
        out = self.both()
        while self.next("or", "||"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.next("and", "&&"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.next("not", "!"):
            return ~self.one()
        if self.next("("):
            out = self.either()
            if not self.next(")"):
                raise ValueError(f"filter {self.text!r}: a bracket isn't closed")
            return out
        return self.test()

    def value(self) -> Column:
        kind, value = self.take("text", "number", "word")
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value))
        if value.lower() not in ("true", "false"):
            raise ValueError(f"filter {self.text!r}: {value} is no literal")
        return F.lit(value.lower() == "true")

    def test(self) -> Column:
        column = F.col(f"`{self.take('word')[1]}`")
        if self.next("is"):
            negated = self.next("not")
            if not self.next("null"):
                raise ValueError(f"filter {self.text!r}: null is missing")
            return column.isNotNull() if negated else column.isNull()
        negated = self.next("not")
        if self.next("in"):
            if not self.next("("):
                raise ValueError(f"filter {self.text!r}: a list is missing")
            values = [self.value()]
            while self.next(","):
                values.append(self.value())
            if not self.next(")"):
                raise ValueError(f"filter {self.text!r}: a list isn't closed")
            out = column.isin(*values)
        elif self.next("like"):
            out = F.like(column, self.value())
        elif self.next("between"):
            low = self.value()
            if not self.next("and"):
                raise ValueError(f"filter {self.text!r}: a range isn't closed")
            out = column.between(low, self.value())
        else:
            op, value = self.next("=", "==", "!=", "<>", "<", "<=", ">", ">="), None
            if negated or not op:
                raise ValueError(f"filter {self.text!r}: a comparison is missing")
            value = self.value()
            return {"=": column == value, "==": column == value, "!=": column != value, "<>": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]
        return ~out if negated else out


def store_filter(text: str) -> Column:
    """A store's filter text as a predicate: comparisons of columns with literals, IN, LIKE, BETWEEN, IS NULL, AND, OR, NOT and brackets.

    The text is parsed, so it reaches no function and names columns only; anything else is a ValueError.
    """
    parsed = _Filter(text)
    out = parsed.either()
    if parsed.at < len(parsed.tokens):
        raise ValueError(f"filter {text!r}: unexpected {parsed.tokens[parsed.at][1]!r}")
    return out


_QUERY = re.compile(r'\s*(?:"(?P<phrase>[^"]*)"|(?P<op>[()+-])|(?P<word>[^\s()"]+))')


def text_query(text: str, terms: Column | Callable[[str], Column]) -> Column:
    """A boolean text query over the array ``terms`` of a text's tokens, in order, or over a function of words that tells whether they stand in the text (null: no token).

    Words side by side or joined by OR: any; AND: both; NOT or ``-``: none; ``+``: wanted beside
    others; quotes: tokens in this order; brackets. Words are tokenized as the texts are, and
    one that leaves no token is left out.
    """
    from ..functions import text as T

    parts, at = [], 0
    while at < len(text.rstrip()):
        m = _QUERY.match(text, at)
        if not m:
            raise ValueError(f"query {text!r}: unexpected {text[at:].strip()[:20]!r}")
        parts.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    at = 0

    def peek(*values: str) -> bool:
        return at < len(parts) and parts[at][0] != "phrase" and parts[at][1] in values

    def run_of(words: str) -> Column:
        if callable(terms) and not isinstance(terms, Column):
            return terms(words)
        found = T.tokenize(F.lit(words))
        joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
        return F.when(F.size(found) > 0, F.contains(joined(terms), joined(found)))

    def atom() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"query {text!r}: a word is missing")
        kind, value = parts[at]
        at += 1
        if (kind, value) == ("op", "("):
            out = either()
            if not peek(")"):
                raise ValueError(f"query {text!r}: a bracket isn't closed")
            at += 1
            return out
        if kind == "op":
            raise ValueError(f"query {text!r}: unexpected {value!r}")
        return run_of(value)

    def both() -> Column:
        nonlocal at
        out = unary()
        while peek("AND"):
            at += 1
            out = _all(out, unary())
        return out

    def unary() -> Column:
        nonlocal at
        if peek("NOT"):
            at += 1
            return ~unary()
        return atom()

    def either() -> Column:
        nonlocal at
        some, needed, barred = [], [], []
        while at < len(parts) and not peek(")"):
            if peek("OR"):
                at += 1
            elif peek("+", "-"):
                into = needed if parts[at][1] == "+" else barred
                at += 1
                into.append(atom())
            else:
                some.append(both())
        out = F.lit(None).cast("boolean")
        for c in some if not needed else ():
            out = F.coalesce(out | c, out, c)
        for c in needed:
            out = _all(out, c)
        for c in barred:
            out = _all(out, ~c)
        return out

    out = either()
    if at < len(parts):
        raise ValueError(f"query {text!r}: a bracket is closed that none opened")
    return F.coalesce(out, F.lit(False))


def _all(a: Column, b: Column) -> Column:
    """Both; a part without tokens (null) asks for nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a & b)
