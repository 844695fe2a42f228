"""Data-quality figures: compliance, coverage, gaps, trends, alerts, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 x part / whole, halves up; 0 of nothing."""
    return F.when(whole > 0, V.round_half_up(100.0 * part / whole, digits)).otherwise(0.0)


def _status() -> list[Column]:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return [n("compliant"), n("stale"), n("unprocessed"), F.count("*").alias("total")]


def compliance(facts: DataFrame, *by: str) -> DataFrame:
    """Counts by status and the score; over everything, or by groups, the best first."""
    g = facts.groupBy(*by).agg(*_status()).withColumn("score", percent(F.col("compliant"), F.col("total")))
    return g.orderBy(F.desc("score"), *by) if by else g


def breakdown(facts: DataFrame, rule: str, previous: DataFrame | None = None) -> DataFrame:
    """By rule: counts, rate, affected rows, their share of all as impact, and the change since the previous rates (rule, rate)."""
    g = facts.filter(F.col(rule).isNotNull()).groupBy(rule).agg(*_status())
    every = F.sum("total").over(Window.partitionBy())
    affected = F.col("total") - F.col("compliant")
    out = g.withColumns({"rate": percent(F.col("compliant"), F.col("total")), "affected": affected, "impact": V.round_half_up(100.0 * affected / every)})
    if previous is not None:
        out = out.join(previous.select(F.col(previous.columns[0]).alias(rule), F.col(previous.columns[1]).alias("__old")), rule, "left").withColumn("delta", V.round_half_up(F.col("rate") - F.col("__old"), 2)).drop("__old")
    return out


def pattern_gaps(facts: DataFrame, rule: str, field: str, raw: str, least: int, most: int = 50) -> DataFrame:
    """Unprocessed raw values that recur, the most frequent first: a report of the top ``most``."""
    v = V.trim(F.lower(F.col(raw)))
    g = facts.filter("status = 'unprocessed'").groupBy(rule, field, v.alias("pattern")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.orderBy(F.desc("n"), rule, field, "pattern").limit(most)


def zero_match(facts: DataFrame, *by: str, least: int) -> DataFrame:
    """Groups without a single compliant row."""
    return facts.groupBy(*by).agg(*_status()).filter((F.col("compliant") == 0) & (F.col("total") >= least)).select(*by, "total")


def coverage(records: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field: filled, missing, total and rounded coverage, from one pass."""
    counts = records.agg(F.count("*").alias("total"), *(F.count_if(~V.is_blank(F.col(f))).alias(f) for f in fields))
    long = counts.select("total", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))).alias("x")).select("x.field", "x.filled", "total")
    return long.withColumns({"missing": F.col("total") - F.col("filled"), "coverage": percent(F.col("filled"), F.col("total"), 0)})


def health(issues: Column, records: Column) -> Column:
    return F.when(records > 0, F.least(F.greatest(V.round_half_up(100.0 - 100.0 * issues / records), F.lit(0.0)), F.lit(100.0))).otherwise(100.0)


def value_frequency(records: DataFrame, field: str) -> DataFrame:
    """Trimmed values by frequency; fewer than three times is suspect; blanks are one row with a null."""
    v = F.when(~V.is_blank(F.col(field)), V.trim(F.col(field)))
    return records.groupBy(v.alias("value")).agg(F.count("*").alias("n")).withColumn("suspect", F.col("value").isNotNull() & (F.col("n") < 3))


def top_pattern(facts: DataFrame, *by: str, raw: str) -> DataFrame:
    """Most frequent raw value of each group, if it occurs more than once; ties to the smaller value."""
    g = facts.groupBy(*by, raw).agg(F.count("*").alias("n"))
    top = g.groupBy(*by).agg(F.min_by(F.struct(F.col(raw).alias("pattern"), "n"), F.struct((-F.col("n")).alias("m"), F.col(raw).alias("v"))).alias("x"))
    return top.select(*by, "x.pattern", "x.n").filter("n > 1")


def alerts(score: DataFrame, rates: DataFrame, rule: str, least_score: float, most_unprocessed: int, least_rate: float) -> DataFrame:
    """Reasons: score below, unprocessed above, a rule's rate below its threshold."""
    row = lambda kind, limit, actual, of: [F.lit(kind).alias("type"), F.lit(float(limit)).alias("threshold"), actual.cast("double").alias("actual"), of.alias("rule")]
    none = F.lit(None).cast("string")
    return (
        score.filter(F.col("score") < least_score).select(*row("score_below", least_score, F.col("score"), none))
        .unionByName(score.filter(F.col("unprocessed") > most_unprocessed).select(*row("unprocessed_above", most_unprocessed, F.col("unprocessed"), none)))
        .unionByName(rates.filter(F.col("rate") < least_rate).select(*row("rate_below", least_rate, F.col("rate"), F.col(rule).cast("string"))))
    )


def trend(history: DataFrame, by: list[str], at: str, value: str, since, until) -> DataFrame:
    """The series within a span of time, each value with the one before and the change."""
    w = Window.partitionBy(*by).orderBy(at)
    rows = history.filter(F.col(at).between(since, until))
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("delta", V.round_half_up(F.col(value) - F.col("previous"), 2))


def projection(total: Column, days: Column, elapsed: Column, included: Column) -> Column:
    """A period's total at the present pace, and what exceeds the plan."""
    projected = V.round_half_up(total * days / elapsed)
    return F.struct(projected.alias("projected"), F.greatest(projected - included, F.lit(0.0)).alias("overage"))


def overlap(results: DataFrame, a: str, b: str, field: str | None = None) -> DataFrame:
    """Both, only one and neither of two sources, and what they match together: a + b (1 - a)."""
    x, y = F.col(a), F.col(b)
    by = [field] if field else []
    n = results.groupBy(*by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.count("*").alias("total"))
    p, q = (F.col("both") + F.col("only_a")) / F.col("total"), (F.col("both") + F.col("only_b")) / F.col("total")
    return n.withColumn("combined", F.round(p + q * (1 - p), 6))


def weighted_score(rates: DataFrame, field: str, rate: str, weights: dict[str, float]) -> DataFrame:
    """Sum of the fields' rates (0 to 100) by weight, rounded; fields without a weight and missing fields add nothing."""
    weight = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(field)]
    return rates.agg(V.round_half_up(F.coalesce(F.sum(F.col(rate) / 100.0 * weight), F.lit(0.0))).alias("score"))


def daily_usage(rows: DataFrame, by: list[str], at: str, amount: str) -> DataFrame:
    """Amount used by group, week and day."""
    return rows.groupBy(*by, F.to_date(F.date_trunc("week", at)).alias("week"), F.to_date(at).alias("day")).agg(F.sum(amount).alias("used"))


def agreement(agree: Column, disagree: Column) -> Column:
    """Share of agreement; null if nobody has judged."""
    return F.try_divide(agree.cast("double"), (agree + disagree).cast("double"))
