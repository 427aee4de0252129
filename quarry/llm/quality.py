"""Quality rules as a learned decision list.

Statistics of each text are DataFrame expressions. Sequential covering learns
rules for low quality from a bounded sample of labelled rows (``sample_rows``):
a rule grows by the threshold with the best gain until it covers no good row,
is pruned on rows it was not grown from, and what it covers is taken out before
the next. The ordered rules become one CASE expression of Spark, so judging a
corpus is a projection, without Python, joins or shuffles.

Null text counts as empty; it has no words and fails the base rule. Ties in the
sample's order break by id. An empty table gives no rows; without labelled rows
of both kinds the list is empty and only the base rule decides. Lines, words and
symbols of very long texts are counted whole.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_ids

#: Statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "exclaim_ratio", "distinct_ratio")


def _occurrences(text: Column, regex: str) -> Column:
    return (F.size(F.split(text, regex, -1)) - 1).cast("long")


def _grams_of(words: Column) -> Column:
    """Hashes of the windows of three words; null under four words, where none can repeat."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(n < 4, F.lit(None)).otherwise(grams)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of the text, from ``n_words`` on, to every row; columns of their names (and of the names of steps, which begin with ``_``) are replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, SPACE), "")
    out = docs.withColumns({"_words": words, "_lines": lines})
    out = out.withColumn("_grams", _grams_of(F.col("_words")))
    any_repeat = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.withColumn("_sorted", F.when(any_repeat, F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    # unless all differ, (hash, place) pairs are sorted; a place counts if a neighbour has the same hash
    place = F.transform("_sorted", lambda p, k: F.when((p["g"] == F.get("_sorted", k - 1)["g"]) | (p["g"] == F.get("_sorted", k + 1)["g"]), p["i"]))
    out = out.withColumn("_places", F.array_sort(F.array_compact(place)))
    gaps = F.aggregate(F.zip_with("_places", F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": _occurrences(text, "[#*$%&|<>]"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(gaps, F.lit(0).cast("long")),
        "_upper": _occurrences(text, r"\p{Lu}"),
        "_exclaim": _occurrences(text, "[!?]"),
        "_distinct": F.size(F.array_distinct("_words")),
    })
    each = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return out.withColumns({
        "mean_word": F.col("word_chars") / each,
        "symbol_ratio": F.col("n_symbols") / each,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / each,
        "upper_ratio": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "exclaim_ratio": F.col("_exclaim") / each,
        "distinct_ratio": F.col("_distinct") / each,
    }).drop("_words", "_lines", "_grams", "_sorted", "_places", "_upper", "_exclaim", "_distinct")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def learn(rows: list[dict], label: str = "bad", bins: int = 24, most_conditions: int = 4, least_covered: int = 5, precision: float = 0.9) -> list[Rule]:
    """An ordered list of rules for rows whose ``label`` is 1, by sequential covering; rows are sets of bits."""
    n = len(rows)
    bad = sum(1 << i for i, r in enumerate(rows) if r[label])
    if not bad or bad.bit_count() == n:
        return []
    masks: dict[Condition, int] = {}
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        cuts = sorted({values[min(len(values) - 1, k * len(values) // bins)] for k in range(bins)} | {sorted(r[f] for r in rows)[min(n - 1, k * n // bins)] for k in range(bins)})
        for cut in cuts:
            for above in (True, False):
                c = Condition(f, above, cut)
                masks[c] = sum(1 << i for i, r in enumerate(rows) if (r[f] >= cut if above else r[f] <= cut))
    everything = (1 << n) - 1
    prune = sum(1 << i for i in range(n) if i % 3 == 2)
    left, rules = everything, []
    cover = lambda rule, within: reduce(operator.and_, (masks[c] for c in rule), within)
    share = lambda m: (m & bad).bit_count() / max(1, m.bit_count())
    while (bad & left & ~prune).bit_count() >= least_covered:
        rule: list[Condition] = []
        now = left & ~prune
        while now & ~bad and len(rule) < most_conditions:
            # FOIL's gain, with the logarithms' order kept by powers of the shares
            best, gain = None, 0.0
            p0 = share(now)
            for c, m in masks.items():
                got = now & m
                p = (got & bad).bit_count()
                if p >= least_covered and (g := p * (_log(share(got)) - _log(p0))) > gain:
                    best, gain = c, g
            if best is None:
                break
            rule.append(best)
            now &= masks[best]
        if not rule:
            break
        worth = lambda r: ((m := cover(r, left & prune)) & bad).bit_count() * 2 - m.bit_count()
        while len(rule) > 1:
            shorter = max(([c for c in rule if c is not d] for d in rule), key=worth)
            if worth(shorter) <= worth(rule):
                break
            rule = shorter
        got = cover(rule, left)
        if (got & bad).bit_count() < least_covered or share(got) < precision:
            break
        rules.append(tuple(rule))
        left &= ~got
    return rules


def _log(x: float) -> float:
    import math

    return math.log2(max(x, 1e-9))


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[dict]:
    """Statistics of at most ``sample_rows`` labelled rows, those of least id hash (none of ids with more than 100 rows): plain numbers, no texts."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = bounded_ids(docs, chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows), sample_rows, id_col)
    rows = statistics(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), text_col)
    got = rows.select(id_col, (F.col("_label") == 0).cast("int").alias("bad"), *FEATURES).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: (r[id_col], r.n_words, r.mean_word))]


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, counted from 1; null where none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, start=1))):
        out = F.when(reduce(operator.and_, (c.column() for c in rule)), F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Every row with its statistics, ``base_failed``, ``rule`` (the first that holds) and ``kept``; columns of these names are replaced."""
    out = statistics(docs, text_col).withColumns({"base_failed": base_failed(), "rule": expression(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def learned(docs: DataFrame, labels: DataFrame, **options) -> list[Rule]:  # noqa: ANN003
    return learn(labelled_statistics(docs, labels, **options))


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with the columns of ``docs`` as they are.

    The row number holds the filter above the projections: pushed below, it would
    be written out in terms of the text and compute every statistic many times.
    """
    out = judge(docs.select(docs[text_col].alias("text"), F.struct("*").alias("row")), rules).withColumn("number", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")
