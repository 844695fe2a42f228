"""One value out of many: waterfalls, aggregates and resolution of candidates from several sources.

Candidates are long rows (record_id, field, provider, value, retrieved_at,
position).  Every form is one grouping by record and field; nothing is sent to
a single task, and blank values never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V

BY = ("record_id", "field")


def _filled(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~V.is_blank(F.col("value")))


def waterfall(candidates: DataFrame, current: DataFrame | None = None, order: str | Column = "position", mode: str = "overwrite") -> DataFrame:
    """First filled value by order; with ``fill_empty`` a filled current value stays."""
    first = _filled(candidates).groupBy(*BY).agg(F.min_by(F.struct("value", "provider"), order).alias("x")).select(*BY, "x.value", F.col("x.provider").alias("source"))
    if current is None or mode == "overwrite":
        return first
    old = current.select(*BY, F.col("value").alias("__old"))
    out = old.join(first, list(BY), "full")
    keep = ~V.is_blank(F.col("__old"))
    return out.select(*BY, F.when(keep, F.col("__old")).otherwise(F.col("value")).alias("value"), F.when(keep, "existing").otherwise(F.col("source")).alias("source"))


def numeric(candidates: DataFrame) -> DataFrame:
    """Largest, smallest and mean numbers of each field, with the providers at both ends."""
    n = candidates.withColumn("n", V.leading_number(F.col("value"))).filter("n IS NOT NULL")
    g = n.groupBy(*BY).agg(F.max("n").alias("max"), F.min("n").alias("min"), F.avg("n").alias("avg"), F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("n", "provider"))).alias("all"))
    at = lambda c: F.array_join(F.array_sort(F.transform(F.filter("all", lambda x: x["n"] == F.col(c)), lambda x: x["provider"])), ",")
    return g.select(*BY, "max", at("max").alias("max_providers"), "min", at("min").alias("min_providers"), V.round_half_up(F.col("avg"), 2).alias("avg"), "count")


def cluster_average(candidates: DataFrame, order: Column | None = None) -> DataFrame:
    """Mean without values farther from the median than the standard deviation; of fewer than three, or if fewer than two are left, of all.

    Where a value is just as far, the last bit of the deviation decides, so it is summed
    up (Welford) value by value, in the order given or else of the values, however rows are dealt.
    """
    n = candidates.withColumn("n", V.leading_number(F.col("value"))).filter("n IS NOT NULL")
    rows = F.sort_array(F.collect_list(F.struct(*([] if order is None else [order.alias("at")]), "n")))
    g = n.groupBy(*BY).agg(F.transform(rows, lambda x: x["n"]).alias("all"), F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"))

    def add(s: Column, x: Column) -> Column:
        count, off = s["count"] + 1, x - s["mean"]
        mean = s["mean"] + off / count
        return F.struct(count.alias("count"), mean.alias("mean"), (s["squares"] + (x - mean) * off).alias("squares"))

    none = F.struct(*(F.lit(0.0).alias(c) for c in ("count", "mean", "squares")))
    g = g.withColumn("spread", F.aggregate("all", none, add, lambda s: F.sqrt(s["squares"] / s["count"])))
    kept = F.filter("all", lambda x: F.abs(x - F.col("median")) <= F.col("spread"))
    mean = lambda a: F.aggregate(F.array_sort(a), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    few = (F.size("all") < 3) | (F.size(kept) < 2)
    return g.select(*BY, V.round_half_up(F.when(few, F.col("mean")).otherwise(mean(kept)), 2).alias("value"), F.when(few, F.size("all")).otherwise(F.size(kept)).alias("used"), F.size("all").alias("count"))


def _rank(provider: Column, order: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), provider)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def priority(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Providers in order, unknown ones last, then as they came."""
    by = F.struct(_rank(F.col("provider"), order).alias("r"), F.col("position").alias("p"))
    return _filled(candidates).groupBy(*BY).agg(F.min_by(F.struct("value", "provider"), by).alias("x")).select(*BY, "x.value", "x.provider")


def recency(candidates: DataFrame) -> DataFrame:
    """The latest; of equally late ones the first that came."""
    by = F.struct(F.col("retrieved_at").alias("t"), (-F.col("position")).alias("p"))
    return _filled(candidates).groupBy(*BY).agg(F.max_by(F.struct("value", "provider"), by).alias("x")).select(*BY, "x.value", "x.provider")


def consensus(candidates: DataFrame) -> DataFrame:
    """The most frequent value; of equally frequent ones the first seen."""
    counts = _filled(candidates).groupBy(*BY, "value").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    by = F.struct(F.col("n").alias("n"), (-F.col("first")).alias("p"))
    return counts.groupBy(*BY).agg(F.max_by(F.struct("value", "n"), by).alias("x")).select(*BY, "x.value", F.col("x.n").alias("votes"))


def conservative(candidates: DataFrame) -> DataFrame:
    """The smallest number if all are numbers, else the shortest text; ties to the first."""
    c = _filled(candidates).withColumn("n", V.number(F.col("value")))
    g = c.groupBy(*BY).agg(F.bool_and(F.col("n").isNotNull()).alias("numbers"), F.min_by("value", F.struct("n", "position")).alias("small"), F.min_by("value", F.struct(F.length("value").alias("l"), F.col("position").alias("p"))).alias("short"))
    return g.select(*BY, F.when(F.col("numbers"), F.col("small")).otherwise(F.col("short")).alias("value"))


def pipeline(candidates: DataFrame, normalize: dict[str, Column], order: list[str]) -> DataFrame:
    """Normalize every candidate first, drop what fails, then resolve by priority."""
    value = F.col("value")
    for field, made in normalize.items():
        value = F.when(F.col("field") == field, made).otherwise(value)
    return priority(candidates.withColumn("value", value), order)


def cached_rows(rows: DataFrame, fields: list[str], order: list[str], now, id: str = "record_id") -> DataFrame:
    """Live cache rows (provider, ttl_expires_at, fields) to one row a record: melt, resolve, pivot."""
    live = rows.filter(F.col("ttl_expires_at") > now)
    melted = live.select(F.col(id).alias("record_id"), "provider", F.lit(0).alias("position"), *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(["record_id", "provider", "position"], fields, "field", "value")
    return priority(melted, order).groupBy("record_id").pivot("field", fields).agg(F.first("value"))


def merge_prospects(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """One row per domain: first filled value by provider order, all technologies, providers joined by +."""
    r = _rank(F.col("provider"), order)
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(r.alias("r"), F.col("provider").alias("p")))).alias(f) for f in fields]
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(r.alias("r"), F.col("provider").alias("p")))), lambda x: x["p"]), "+").alias("provider")
    return rows.groupBy("domain").agg(*first, F.array_sort(F.array_distinct(F.flatten(F.collect_list("technologies")))).alias("technologies"), names)


def latest_per_key(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert: the latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
