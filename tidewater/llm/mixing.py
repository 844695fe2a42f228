"""Mixing sources to target weights.

Tokens per source are summed first, so that rates rest on every document; the
rates then turn into copies: floor(rate), and one more if a hash of the row,
seeded, falls below the rate's fraction.  A rerun draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_dimension, n_words, spare

#: Hexadecimal digits of the digest that make the draw: 13 of them fit a double exactly.
DIGITS = 13
NAMES = ("size", "source_size", "target", "rate", "copies")


def draw(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from an MD5 digest of the seed and the columns (null: empty)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in of)))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def in_order(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """The rows with ``part``, the number of a range of the order; equal rows share a part.  Stored, so that ranges stay as they are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.write(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)


def before_parts(placed: DataFrame, **sums: Column) -> DataFrame:
    """For each part, each sum over all parts before it.  One row a part, so the window over all of them is as short as a list of tasks."""
    totals = placed.groupBy("part").agg(*(c.alias(name) for name, c in sums.items()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """(source, size) with weights for the sources by code point, null last, repeating.  Sources are ranked in ranges, so any number of tasks can share them."""
    order = F.col("source").asc_nulls_last()
    placed = in_order(sources, [order], scratch, "by-name")
    ranked = placed.join(F.broadcast(before_parts(placed, earlier=F.count("*"))), "part")
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.col("earlier") - 1
    return ranked.select("source", "size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at % len(weights) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float, most: float, scratch: Scratch) -> DataFrame:
    """Target words of each source: share of all words, dealt by weight, none above most times its size.

    ``sources`` has source, size and weight.  The excess of a source at its limit goes
    to the others by weight until none is above, which means target = min(most
    * size, level * weight) for one level.  With sources in the order of
    limit / weight, the level is the first at which the next one fits.
    """
    s = sources.withColumn("cap", F.col("size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    placed = in_order(s, [F.col("ratio"), F.col("weight")], scratch, "by-ratio")
    every = placed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total, whole = float(every["size"] or 0) * share, every["weight"] or 0.0
    upto, own = Window.partitionBy("part").orderBy("ratio", "weight").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("part", "ratio", "weight")
    earlier = lambda c: F.col(f"{c}_before") + F.sum(c).over(upto) - F.sum(c).over(own)
    s = placed.join(F.broadcast(before_parts(placed, cap_before=F.sum("cap"), weight_before=F.sum("weight"))), "part")
    s = s.withColumn("capped", earlier("cap")).withColumn("rest", F.lit(whole) - earlier("weight"))
    # a source is below its limit if the level that all before it leave does not reach its limit
    s = s.withColumn("free", (F.lit(total) - F.col("capped")) * F.col("weight") <= F.col("cap") * F.col("rest"))
    first = s.filter("free").agg(F.min(F.struct("capped", (-F.col("rest")).alias("neg"))).alias("x")).select("x.*").first()
    level = F.when(F.col("free"), (F.lit(total) - first["capped"]) * F.col("weight") / -first["neg"]).otherwise(F.col("cap")) if first["neg"] is not None else F.col("cap")
    return s.select("source", "size", "weight", level.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17,
        id: str = "doc_id", source: str = "source", text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with size, source_size, target, rate and copies (each name behind ``prefix``); emit() repeats them.

    Weights are positive.  Null text has size 0; a null source is a source of
    its own, the last.  A source without words has target and rate 0, so its
    documents are left out.  Rows alike in id and text draw alike.  An empty
    table gives an empty result.  Other columns pass through; those with one of
    the five names are replaced, unless a prefix keeps them apart.
    """
    size, whole, target, rate, copies = (prefix + x for x in NAMES)
    own, scratch = spare("source", [*docs.columns, size, whole, target, rate, copies]), Scratch(docs.sparkSession, "mixing")
    sized = docs.withColumn(size, n_words(F.col(text)))
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    plan = targets(cyclic_weights(sums, weights, scratch), share, most, scratch)
    plan = scratch.write(plan.select(F.col("source").alias(own), F.col("size").alias(whole), F.col("target").alias(target)), "sources")
    scratch.drop("by-name", "by-ratio")
    out = join_dimension(sized.drop(whole, target, rate, copies).withColumn(own, F.col(source)), plan, own, plan.count()).drop(own)
    out = out.withColumn(rate, F.when(F.col(whole) > 0, F.col(target) / F.col(whole)).otherwise(F.lit(0.0)))
    extra = draw(seed, F.col(id), F.md5(F.coalesce(F.col(text), F.lit("")))) < F.col(rate) - F.floor(rate)
    return out.withColumn(copies, F.floor(rate).cast("bigint") + extra.cast("bigint"))


def emit(mixed: DataFrame, prefix: str = "") -> DataFrame:
    """Each row of a mix as often as its copies say, without the columns of the mix."""
    n = F.col(prefix + "copies").cast("int")
    copy = spare("copy", mixed.columns)
    repeated = mixed.filter(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n)))
    return repeated.drop(copy, *(prefix + x for x in NAMES))
