"""How well a prospect fits a profile, and what calibration decisions agree on."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import values as V

# Points of a full score in each part of a profile.
POINTS = {"industry": 35, "size": 25, "location": 20, "technology": 15}


def _among(c: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.lower(c).isin([w.lower() for w in wanted]), F.lit(False)) if wanted else F.lit(False)


def industry_fit(industry: Column, wanted: list[str]) -> Column:
    """100 for an equal industry, 60 for one that holds a wanted one or is held by it, whichever comes first in the list."""
    if not wanted:
        return F.lit(100)
    low, out = F.lower(industry), F.lit(0)
    for w in reversed([w.lower() for w in wanted]):
        out = F.when(low == w, 100).when(low.contains(w) | F.lit(w).contains(low), 60).otherwise(out)
    return F.when(F.coalesce(industry, F.lit("")) == "", 0).otherwise(out)


def size_fit(n: Column, low: int | None = None, high: int | None = None) -> Column:
    """100 inside the range, falling by the share of the missed end; nothing without a number."""
    if low is None and high is None:
        return F.lit(100.0)
    out = F.when(n.isNull() | (n == 0), 0.0)
    if low is not None:
        out = out.when(n < low, F.greatest(F.lit(0.0), 100 - (low - n) / low * 100))
    if high is not None:
        out = out.when(n > high, F.greatest(F.lit(0.0), 100 - (n - high) / high * 100) if high else 0.0)
    return out.otherwise(100.0)


def location_fit(city: Column, state: Column, country: Column, cities: list[str] = (), states: list[str] = (), countries: list[str] = ()) -> Column:
    """100 for a wanted city, 80 for a state, 60 for a country; 100 if nothing is wanted."""
    if not (cities or states or countries):
        return F.lit(100)
    return F.when(_among(city, cities), 100).when(_among(state, states), 80).when(_among(country, countries), 60).otherwise(0)


def technology_fit(have: Column, wanted: list[str]) -> Column:
    """Share of wanted technologies that one of a company's own contains."""
    if not wanted:
        return F.lit(100.0)
    low = F.transform(F.coalesce(have, F.array().cast("array<string>")), F.lower)
    holds = lambda w: F.exists(low, lambda t: t.contains(w)).cast("int")
    met = [holds(w.lower()) for w in wanted]
    return reduce(lambda a, b: a + b, met) / len(wanted) * 100


def profile_score(profile: dict[str, Any], industry: Column, employees: Column, city: Column, state: Column, country: Column, technologies: Column) -> Column:
    """Struct of score, the rounded total of at most 95 points, and the rounded points of each part.

    ``profile`` may have industries, employee_min, employee_max, cities, states, countries and technologies; a part about which it says nothing is full.
    """
    parts = {
        "industry": industry_fit(industry, profile.get("industries", [])), "size": size_fit(employees, profile.get("employee_min"), profile.get("employee_max")),
        "location": location_fit(city, state, country, profile.get("cities", []), profile.get("states", []), profile.get("countries", [])), "technology": technology_fit(technologies, profile.get("technologies", [])),
    }
    points = {k: parts[k] / 100 * full for k, full in POINTS.items()}
    whole = lambda c: V.round_half_up(c).cast("int")
    return F.struct(whole(reduce(lambda a, b: a + b, points.values())).alias("score"), *(whole(c).alias(k) for k, c in points.items()))


def consistency(decisions: DataFrame, by: str, chose: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """Preferences that decisions agree on: at least ``least`` of them, and a share one way."""
    g = decisions.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(chose).cast("double")).alias("ratio")).filter(F.col("n") >= least)
    return g.filter((F.col("ratio") >= share) | (F.col("ratio") <= 1 - share)).withColumn("prefers", F.col("ratio") >= share)


def suggested_rules(decisions: DataFrame, samples: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """(field, strategy, confidence, sample_count) of survivor rules that decisions on sampled pairs agree on.

    ``decisions`` has pair_id, verdict and survivor_preference (a, b or auto), ``samples`` has pair_id and structs a and b
    with name, domain, created and whatever else counts as filled.  Only duplicates with a preference say anything, and
    about a signal only those that differ in it: a longer name, a .com domain, a later date, more filled fields.
    """
    chosen = decisions.filter((F.col("verdict") == "duplicate") & F.col("survivor_preference").isin("a", "b")).select("pair_id", (F.col("survivor_preference") == "a").alias("first"))
    pairs = samples.select("pair_id", "a", "b").join(chosen, "pair_id")
    a, b = F.col("a"), F.col("b")
    filled = lambda r: reduce(lambda x, y: x + y, (F.coalesce(r[f].cast("string") != "", F.lit(False)).cast("int") for f in samples.schema["a"].dataType.names))
    ends = lambda r: F.when(r["domain"] != "", F.element_at(F.split(r["domain"], r"\."), -1) == "com")
    sides = {
        ("name", "prefer_longest"): [F.length(V.text(r["name"])) for r in (a, b)], ("domain", "tld_preference"): [ends(r).cast("int") for r in (a, b)],
        ("createdate", "prefer_newest"): [V.timestamp(r["created"]).cast("double") for r in (a, b)], ("*", "prefer_nonempty"): [filled(r) for r in (a, b)],
    }
    votes = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s).alias("strategy"), F.when(x != y, F.col("first") == (x > y)).alias("vote")) for (f, s), (x, y) in sides.items()))
    said = pairs.select(F.explode(votes).alias("v")).select("v.*").filter("vote IS NOT NULL")
    g = said.groupBy("field", "strategy").agg(F.avg(F.col("vote").cast("double")).alias("ratio"), F.count("*").alias("sample_count"))
    return g.filter((F.col("sample_count") >= least) & (F.col("ratio") >= share)).select("field", "strategy", V.round_half_up(F.col("ratio") * 100).cast("int").alias("confidence"), "sample_count")
