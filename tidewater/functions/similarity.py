"""Similarity of texts: edit distance, trigrams, Jaro-Winkler."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import values as V


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, without case; 0 with a null or an empty side."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / longer)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler with the prefix bonus at any score, without case; 0 with a null or an empty side.

    Built-in array functions: for each letter of the one text the first free
    equal letter of the other within reach is taken, in order.
    """
    letters = lambda c: F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    none = F.array().cast("array<int>")

    def scored(p: Column) -> Column:
        x, y = p["x"], p["y"]
        n, m = F.size(x), F.size(y)
        reach = F.floor(F.greatest(n, m) / 2).cast("int") - 1

        def take(state: Column, i: Column) -> Column:
            low, high = F.greatest(i - reach, F.lit(0)), F.least(i + reach, m - 1)
            free = F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(none), lambda j: (F.get(y, j) == F.get(x, i)) & ~F.array_contains(state["theirs"], j))
            hit = F.size(free) > 0
            return F.struct(F.when(hit, F.concat(state["mine"], F.array(i))).otherwise(state["mine"]).alias("mine"), F.when(hit, F.concat(state["theirs"], F.slice(free, 1, 1))).otherwise(state["theirs"]).alias("theirs"))

        start = F.struct(none.alias("mine"), none.alias("theirs"))
        found = F.aggregate(F.sequence(F.lit(0), n - 1), start, take)

        def jaro(s: Column) -> Column:
            k = F.size(s["mine"])
            theirs = F.array_sort(s["theirs"])
            moved = F.size(F.filter(F.zip_with(s["mine"], theirs, lambda i, j: F.get(x, i) != F.get(y, j)), lambda d: d)) / 2
            same = F.size(F.filter(F.sequence(F.lit(0), F.least(n, m, F.lit(4)) - 1), lambda i: F.slice(x, 1, i + 1) == F.slice(y, 1, i + 1)))
            base = (k / n + k / m + (k - moved) / k) / 3
            return F.when(k == 0, 0.0).otherwise(F.least(base + same * 0.1 * (1 - base), F.lit(1.0)))

        return F.when(reach < 0, 0.0).otherwise(V.let(found, jaro))

    pair = F.struct(letters(a).alias("x"), letters(b).alias("y"))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(V.let(pair, scored))
