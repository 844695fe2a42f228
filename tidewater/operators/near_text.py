"""All pairs of short texts within an edit similarity, without meeting all pairs of a block.

A pair with longer length L is similar from a threshold t on if at most
k = floor((1 - t) L) edits part them.  For small k both have a common
subsequence of L - k letters, so each text is known by what is left of it after
so many deletions, and texts that agree in most of their letters meet only where
the rest agrees as well.  For larger k the shorter text is cut into k + 1
pieces, of which one must stand unchanged, and nearly in its place, in the
longer.  Both tests lose no pair; what meets is compared in full.

Where texts of a block begin and end alike, rests and pieces are shared by many
that are not similar.  A sample tells such blocks, and their texts are compared
in tiles (near_tiles) that lose no pair either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import near_tiles
from tidewater.storage import Scratch

#: Edits up to which texts meet by deletions, and length from which they meet by length alone (pieces would be more than the pairs of names are).
DELETIONS = 2
LONG = 120
#: A block of more than CROWD texts is compared in tiles if, of about CROWD of them, one pair in SELDOM or more would meet by keys.
CROWD, SELDOM = 512, 20


def _edits(n: Column, threshold: float) -> Column:
    """Edits that a pair may have whose longer text has n letters."""
    return F.floor(n * (1 - threshold) + 1e-9).cast("int")


def _shorter(texts: Column) -> Column:
    """All texts with one letter less."""
    less = lambda v: F.transform(F.filter(F.sequence(F.lit(1), F.length(v)), lambda p: p <= F.length(v)), lambda p: F.concat(F.left(v, p - 1), F.substr(v, p + 1)))
    return F.array_distinct(F.flatten(F.transform(texts, less)))


def _rests(text: Column, deleted: Column) -> Column:
    """What can be left of a text after so many deletions."""
    out, now = F.array(text), F.array(text)
    for k in range(1, DELETIONS + 1):
        now = _shorter(now)
        out = F.when(deleted >= k, now).otherwise(out)
    return out


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def near_texts(rows: DataFrame, threshold: float = 0.85, id: str = "id", text: str = "text", block: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): classes has (id, class), the smallest id of those with the same text (in the same block); pairs has
    (a, b, similarity) of classes with different texts and a similarity of ``threshold`` or more, a < b.

    Similarity is 1 - edit distance / longer length.  Rows with a null id, text or block take no part; empty texts are
    like nothing but each other.  Texts of more than LONG letters meet all of a possible length in their block.
    """
    scratch = Scratch(rows.sparkSession, "near-texts")
    own = rows.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), (F.col(block).cast("string") if block else F.lit("")).alias("block")).dropna()
    own = scratch.write(own, "rows")
    texts = scratch.write(own.groupBy("block", "text").agg(F.min("id").alias("class")).withColumn("n", F.length("text")), "texts")
    classes = own.join(texts, ["block", "text"]).select("id", "class")
    filled = texts.filter("n > 0")
    crowded = scratch.write(_crowded(filled, threshold, scratch), "crowded")
    top = LONG
    while near_tiles.edits(top, threshold) > near_tiles.EDITS:
        top -= 1
    many = scratch.write(filled.join(F.broadcast(crowded), "block", "left_semi").select(*texts.columns), "many")
    few = filled.join(F.broadcast(crowded), "block", "left_anti").select(*texts.columns)
    if few.isEmpty() and many.filter(F.col("n") / threshold > top).isEmpty():
        return classes, near_tiles.tiles(many, threshold, scratch)
    met = scratch.write(_by_keys(few, threshold).unionByName(_by_length(few, threshold, LONG)).unionByName(_by_length(many, threshold, top)).distinct(), "met")
    side = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"{c}_text"), F.col("block").alias(f"{c}_block"))
    both = met.join(side("a"), "a").join(side("b"), "b").filter("a_block = b_block")
    similar = 1 - F.levenshtein("a_text", "b_text") / F.greatest(F.length("a_text"), F.length("b_text"))
    pairs = both.withColumn("similarity", similar).filter(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")
    short = many.filter(F.col("n") <= top)
    return classes, pairs if crowded.isEmpty() or short.isEmpty() else pairs.unionByName(near_tiles.tiles(short, threshold, scratch))


def _crowded(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Blocks whose texts would meet too often by their keys."""
    large = texts.groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size") > CROWD)
    some = texts.join(large, "block").filter(F.pmod(F.xxhash64("text"), F.col("size")) < CROWD).select(*texts.columns)
    some = scratch.write(some, "some")
    met = _by_keys(some, threshold).join(some.select(F.col("class").alias("a"), "block"), "a").groupBy("block").agg(F.count("*").alias("met"))
    drawn = some.groupBy("block").agg(F.count("*").alias("drawn"))
    return met.join(drawn, "block").filter(F.col("met") * SELDOM * 2 > F.col("drawn") * F.col("drawn")).select("block")


def _longer(filled: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Texts as the shorter of a pair, for each length L that the longer may have, and as the longer; k edits."""
    longest = F.floor(F.col("n") / threshold + 1e-9).cast("int")
    shorter = filled.withColumn("L", F.explode(F.sequence(F.col("n"), longest))).withColumn("k", _edits(F.col("L"), threshold)).filter("L - n <= k")
    return shorter, filled.withColumn("L", F.col("n")).withColumn("k", _edits(F.col("n"), threshold))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select("class", "n", "L", F.xxhash64("block", "L", key).alias("key"))


def _by_length(filled: DataFrame, threshold: float, above: int) -> DataFrame:
    """Pairs whose longer text has more letters."""
    shorter, longer = (_keyed(df.filter(F.col("L") > above), "L") for df in _longer(filled, threshold))
    return _meet(shorter, longer)


def _by_keys(filled: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose longer text has LONG letters at most, by common rests or pieces; a pair comes more than once."""
    shorter, longer = _longer(filled, threshold)
    few = lambda df: df.filter((F.col("k") <= DELETIONS) & (F.col("L") <= LONG))
    rest = lambda df, d: _keyed(df.withColumn("rest", F.explode(_rests(F.col("text"), d))), "rest")
    met = _meet(rest(few(shorter), F.col("k") - F.col("L") + F.col("n")), rest(few(longer), F.col("k")))

    many = lambda df: df.filter((F.col("k") > DELETIONS) & (F.col("L") <= LONG))
    start = lambda n, i: F.floor(i * n / (F.col("k") + 1)).cast("int")
    piece = lambda n, i: start(n, i + 1) - start(n, i)
    cut = many(shorter).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("part", F.concat_ws(":", "n", "i", F.substr("text", start(F.col("n"), F.col("i")) + 1, piece(F.col("n"), F.col("i")))))
    other = many(longer).withColumn("m", F.explode(F.sequence(F.greatest(F.col("n") - F.col("k"), F.lit(1)), F.col("n")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    gap, at = F.col("n") - F.col("m"), start(F.col("m"), F.col("i"))
    first, last = F.greatest(at - F.floor((F.col("k") - gap) / 2).cast("int"), F.lit(0)), F.least(at + F.floor((F.col("k") + gap) / 2).cast("int"), F.col("n") - piece(F.col("m"), F.col("i")))
    other = other.withColumn("p", F.explode(_range(first, last))).withColumn("part", F.concat_ws(":", "m", "i", F.substr("text", F.col("p") + 1, piece(F.col("m"), F.col("i")))))
    return met.unionByName(_meet(_keyed(cut, "part"), _keyed(other, "part")))


def _meet(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a text and one that is longer, or as long, with a common key."""
    x, y = short.select(F.col("class").alias("x"), F.col("n").alias("m"), "key"), long.select(F.col("class").alias("y"), "n", "key")
    met = x.join(y, "key").filter((F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
