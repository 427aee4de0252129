"""Code-aware text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in code search, natural language first, then programming.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need "
    "dare ought used if then else when where why how all any both each few more most other some such no nor not only own "
    "same so than too very just but for and or this that these those i me my we our you your it its they them their what "
    "which who of in on at to from by with about as into through during before after above below up down out off over "
    "under again func def var let const type struct class interface enum return import package public private protected "
    "static void int str string bool true false nil null none new make self super case switch break continue goto try "
    "catch throw raise err error ctx context"
).split()

#: Fixed value: how often each field is repeated in weighted text.
FIELD_WEIGHTS = {"symbol": 3, "name": 3, "file": 2, "content": 1}

TERM_SPACE = 65_536

#: Runs of letters and digits; the places where camel case is cut.
RUNS, CAMEL = r"([\p{L}\p{Nd}]+)", r"(?<=\P{Lu})(?=\p{Lu})"


def words(text: Column) -> Column:
    """Runs of letters and digits, cut before an upper-case letter that follows none, lower-cased."""
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))
    return F.flatten(F.transform(runs, lambda w: F.transform(F.split(w, CAMEL), F.lower)))


def tokenize(text: Column) -> Column:
    """``words`` of two bytes or more that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words(text), lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t))


def kept_term(term: Column) -> Column:
    """The same rule for one word, as a set membership the optimizer can hash."""
    return (F.octet_length(term) >= 2) & ~term.isin(*STOP_WORDS)


def term_hash(term: str) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes of a column, modulo 65,536."""
    byte = f"cast(conv(hex(substring(encode({term}, 'UTF-8'), i, 1)), 16, 10) as bigint)"
    return F.expr(f"case when octet_length({term}) = 0 then 2166136261L % {TERM_SPACE} else aggregate(sequence(1, octet_length({term})), 2166136261L, (h, i) -> ((h ^ {byte}) * 16777619L) & 4294967295L) % {TERM_SPACE} end").cast("int")


def weighted_text(symbol: Column, name: Column, file: Column, content: Column) -> Column:
    """Fields repeated by weight and joined by spaces; a name equal to the symbol is left out."""
    def again(c: Column, n: int) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.trim(F.repeat(F.concat(c, F.lit(" ")), n)))

    other = F.when(~name.eqNullSafe(symbol), name)
    w = FIELD_WEIGHTS
    return F.concat_ws(" ", again(symbol, w["symbol"]), again(other, w["name"]), again(file, w["file"]), again(content, w["content"]))


def one_line(text: Column, most: int = 96) -> Column:
    """White space made single; over ``most`` characters cut and marked by dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Path segments that say nothing about a project.
GENERIC_SEGMENTS = "home users user usr opt var etc tmp".split()


def project_name(path: Column) -> Column:
    """Slug of the last segment, then those of its meaningful ancestors, nearest first."""
    parts = F.reverse(F.filter(F.transform(F.split(path, "/"), slug), lambda s: s != ""))
    near = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: ~s.isin(*GENERIC_SEGMENTS))
    return F.array_join(F.concat(F.slice(parts, 1, 1), near), "-")


def strip_number(name: Column) -> Column:
    return F.regexp_replace(name, r"-[0-9]+$", "")


def free_name(candidate: str, taken: set[str] | None, most: int = 100) -> str:
    """The candidate, or its stem with the first free number from 2."""
    import re

    taken = taken or set()
    if candidate not in taken:
        return candidate
    stem = re.sub(r"-\d+$", "", candidate)
    for k in range(2, most + 1):
        if f"{stem}-{k}" not in taken:
            return f"{stem}-{k}"
    raise ValueError(f"no free name for {candidate}")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/$", "")


def mask_key(key: Column, tail: int = 4, short: int = 8) -> Column:
    """First four and last ``tail`` characters; short keys are hidden whole."""
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("(unset)")).when(F.length(key) <= short, F.lit("***")).otherwise(F.concat(F.left(key, F.lit(4)), F.lit("..."), F.right(key, F.lit(tail))))


def number_or(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def positive_or_one(text: Column) -> Column:
    return F.greatest(F.lit(1), number_or(text, 1))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.5, "mid").otherwise("low")
