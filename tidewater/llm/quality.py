"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is a built-in expression over the row's own text: no user function,
no shuffle, no join.  Costly steps are guarded by cheap ones: windows that
recur are looked for only in texts that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, spare

SYMBOLS = "#*$%&|<>"

# Frequent function words of four languages.
STOP_WORDS = (
    "the a an of and to in is on that for it with as was by this be are from at have not or "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine "
    "le la les de des et en un une du que pour dans est par sur au qui "
    "el los las y que se del una por con para es no su al lo"
).split()

#: (measure, least, most); a text is kept if every measure lies within.  None: no bound.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_length", 2.0, 15.0),
    ("symbol_ratio", None, 0.05),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("repeat_word_ratio", None, 0.5),
    ("upper_word_ratio", None, 0.5),
)


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the text.

    Windows are told apart by a 64-bit hash chained over their words.  Those
    that recur are the equal neighbours in sorted order; with up to 32 of them
    each window is looked up in the list, else windows are sorted with their
    places, so that long repetitive texts stay at n log n.
    """
    n = F.size(words)
    keys = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(_repeats(keys, n)).cast("bigint")


def _repeats(keys: Column, n: Column) -> Column:
    # a let: the keys and what recurs are computed once and bound to a lambda's variable
    def with_keys(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(F.sort_array(k), lambda s: let(F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))), lambda r: F.when(F.size(r) <= 32, covered(places(k, r))).otherwise(covered(let(by_place(k), sorted_places))))))

    def places(k: Column, again: Column) -> Column:
        return F.filter(F.transform(k, lambda x, i: F.when(F.array_contains(again, x), i)), lambda p: p.isNotNull())

    def by_place(k: Column) -> Column:
        return F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))

    def sorted_places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(F.when(j > 0, F.get(s, j - 1)["k"] == x["k"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return let(keys, with_keys)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def assess(docs: DataFrame, rules: tuple[tuple[str, float | None, float | None], ...] = RULES, text: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratios and kept.

    A null text has no words; a text without words has ratio 0 throughout and
    fails.  Columns of the same names are replaced; others pass through.
    """
    names = [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    t_, w_, lines_, n_, stop_, upper_ = (spare(x, names) for x in ("t", "w", "lines", "n", "stop", "upper"))
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(t_, t).withColumn(w_, F.filter(F.split(t_, SPACE_CLASS + "+", -1), lambda w: w != ""))
    words, t = F.col(w_), F.col(t_)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = out.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(without(t, SPACES)).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("bigint"),
        lines_: lines,
        "n_repeat_words": n_repeat_words(words),
        stop_: F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        upper_: F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w))),
    })
    out = out.withColumn("n_dup_lines", (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("bigint")).withColumn(n_, F.size(lines_)).drop(lines_, w_, t_)
    ratio = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    out = out.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word_length": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "word_chars"), "stop_word_ratio": ratio(stop_, "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", n_), "repeat_word_ratio": ratio("n_repeat_words", "n_words"), "upper_word_ratio": ratio(upper_, "n_words"),
    })
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules)).drop(stop_, upper_, n_)


def compiled(rules: tuple[tuple[str, float | None, float | None], ...]) -> Column:
    """The table of thresholds as one boolean expression."""
    verdict = F.lit(True)
    for measure, least, most in rules:
        if least is not None:
            verdict &= F.col(measure) >= least
        if most is not None:
            verdict &= F.col(measure) <= most
    return verdict
