"""Flows over providers: pulls, waterfalls with lookups, two-stage industries, simulated cascades, issues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.operators import lookup, resolve


def union_providers(answers: dict[str, DataFrame]) -> DataFrame:
    """All providers' rows in one table with the provider's name; columns that one lacks are null."""
    named = [rows.withColumn("provider", F.lit(p)) for p, rows in answers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def pull(answers: dict[str, DataFrame], fields: list[str], id: str = "record_id") -> DataFrame:
    """Candidates (record_id, field, provider, value, position) from the tables of several providers, in their order; one pass over each."""
    order = F.create_map(*(F.lit(x) for k, p in enumerate(answers) for x in (p, k)))
    rows = union_providers({p: t.select(F.col(id).alias("record_id"), *(F.col(f).cast("string").alias(f) for f in fields if f in t.columns)) for p, t in answers.items()})
    have = [f for f in fields if f in rows.columns]
    long = rows.unpivot(["record_id", "provider"], have, "field", "value")
    return long.filter(~V.is_blank(F.col("value"))).withColumn("position", order[F.col("provider")])


def field_waterfall(candidates: DataFrame, current: DataFrame, mode: str = "overwrite", how: str = "waterfall", reference: DataFrame | None = None, **lookup_how: Any) -> DataFrame:
    """One field's new values: (record_id, field, value, raw, source, written).

    ``how`` is waterfall, the first filled value by position, or max, min,
    average or cluster_average of the numbers.  With ``fill_empty`` a filled
    current value stays.  A reference table, if given, is looked up with what
    was found; what it does not know stays as it is.
    """
    if how == "waterfall":
        found = resolve.waterfall(candidates, current, mode=mode)
    elif how == "cluster_average":
        found = resolve.cluster_average(candidates).select(*resolve.BY, F.col("value").cast("string").alias("value"), F.lit(how).alias("source"))
    else:
        found = resolve.numeric(candidates).select(*resolve.BY, F.col({"max": "max", "min": "min", "average": "avg"}[how]).cast("string").alias("value"), F.lit(how).alias("source"))
    found = found.withColumn("raw", F.col("value")).withColumn("written", F.coalesce(F.col("source") != "existing", F.lit(False)) & F.col("value").isNotNull())
    if reference is None:
        return found
    known = lookup.lookup(found.filter("written").select("value"), reference, **lookup_how).filter("canonical IS NOT NULL").select(F.col("value").alias("__v"), "canonical")
    return found.join(known, F.col("value") == F.col("__v"), "left").withColumn("value", F.when(F.col("written"), F.coalesce("canonical", "value")).otherwise(F.col("value"))).drop("__v", "canonical")


def industry_two_stage(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """rows (record_id, provider_label, naics_code, naics_label) to the enum's value; on a miss the raw label and code go to fallback columns."""
    found = lookup.crosswalk(rows, crosswalk)
    miss = F.col("value").isNull()
    return found.select(
        "record_id", F.col("value").alias("industry"), F.when(miss, F.coalesce(V.filled(F.col("naics_label")), V.filled(F.col("provider_label")))).alias("fallback_industry"),
        F.when(miss, F.col("naics_code")).alias("fallback_code"),
    )


def triggered(kind: str, config: dict[str, Any], data: Column, last_error: Column, last_fields: Column, first: bool) -> Column:
    """Whether a step of a cascade runs: always, on_error, on_empty, on_missing_field, on_field_present or on_condition; the first always does.

    ``data`` is a map of the fields so far; a step that was skipped has no error and no fields.
    """
    if first or kind == "always":
        return F.lit(True)
    if kind == "on_error":
        return last_error.isNotNull()
    if kind == "on_empty":
        return last_fields == 0
    if kind in ("on_missing_field", "on_field_present"):
        if not config.get("field"):
            return F.lit(False)
        missing = F.coalesce(F.try_element_at(data, F.lit(config["field"])) == "", F.lit(True))
        return missing if kind == "on_missing_field" else ~missing
    return F.lit(kind == "on_condition" and bool(config.get("condition")))


def simulate(cases: DataFrame, steps: Sequence[dict[str, Any]], answers: DataFrame) -> DataFrame:
    """A cascade over test cases (case, data map): rows (case, position, provider, triggered, fields, error, duration_ms).

    answers (case, provider, data, error, duration_ms) say what a provider
    would return.  State grows from step to step within a row, so the whole
    cascade is one projection after one join.
    """
    told = answers.groupBy("case").agg(F.map_from_entries(F.collect_list(F.struct("provider", F.struct("data", "error", "duration_ms")))).alias("told"))
    out = cases.join(told, "case", "left").withColumns({"__data": F.col("data"), "__error": F.lit(None).cast("string"), "__fields": F.lit(0)})
    for k, step in enumerate(steps):
        answer = F.try_element_at("told", F.lit(step["provider"]))
        runs = triggered(step.get("trigger", "always"), step.get("config", {}), F.col("__data"), F.col("__error"), F.col("__fields"), k == 0)
        out = out.withColumn("__runs", F.coalesce(runs, F.lit(False)))
        own = F.when(F.col("__runs"), F.coalesce(answer["data"], F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>"))
        error = F.when(F.col("__runs"), answer["error"])
        row = F.struct(F.lit(k).alias("position"), F.lit(step["provider"]).alias("provider"), F.col("__runs").alias("triggered"), F.array_sort(F.map_keys(own)).alias("fields"), error.alias("error"), F.when(F.col("__runs"), F.coalesce(answer["duration_ms"], F.lit(0))).otherwise(0).alias("duration_ms"))
        merged = F.map_concat(F.map_filter("__data", lambda key, _: ~F.map_contains_key(own, key)), own)
        out = out.withColumns({f"__step{k}": row, "__data": merged, "__error": error, "__fields": F.size(own)})
    return out.select("case", F.explode(F.array(*(F.col(f"__step{k}") for k in range(len(steps))))).alias("s")).select("case", "s.*")


def lookup_issues(records: DataFrame, field: str, reference: DataFrame, org: str) -> DataFrame:
    """Number of filled values that are no canonical value of an organisation or of all, without case; 0 without a reference."""
    known = lookup.active(reference, org).select(F.lower("canonical_value").alias("__k")).distinct()
    filled = records.filter(~V.is_missing(F.col(field))).select(F.lower(field).alias("__k"))
    if known.isEmpty():
        return filled.agg(F.lit(0).cast("bigint").alias("issues"))
    return filled.join(known, "__k", "left_anti").agg(F.count("*").alias("issues"))


def format_issues(records: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(field, issues): how many filled values of each field fail its format test; one pass for all of them."""
    counts = records.agg(*(F.count_if(~V.is_missing(F.col(f)) & ~F.coalesce(ok, F.lit(False))).alias(f) for f, ok in tests.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("issues")) for f in tests))).alias("x")).select("x.*")


def mark_stale(rows: DataFrame, current: DataFrame, rule: str = "rule_id", version: str = "version") -> DataFrame:
    """Compliant rows whose rule has another version by now become stale; rules without a current version stay as they are."""
    now = current.select(F.col(rule).alias("__rule"), F.col(version).alias("__now"))
    old = F.coalesce((F.col(version) != F.col("__now")) & (F.col("status") == "compliant"), F.lit(False))
    return rows.join(now, F.col(rule) == F.col("__rule"), "left").withColumn("status", F.when(old, "stale").otherwise(F.col("status"))).drop("__rule", "__now")


def row_filter(filters: dict[str, Any], title: str | None = None) -> Column:
    """Filters of an import: a list of values (levels for the title column), {"contains": text} or {"not_contains": text}; all must hold."""
    from tidewater.functions.names import job_level

    out = F.lit(True)
    for name, want in filters.items():
        c = F.col(name)
        if isinstance(want, list):
            test = (job_level(c) if name == title else c).isin(*want)
        elif want.get("contains"):
            test = F.lower(c).contains(want["contains"].lower())
        elif want.get("not_contains"):
            test = ~F.lower(V.text(c)).contains(want["not_contains"].lower())
        else:
            continue
        out = out & F.coalesce(test, F.lit(False))
    return out


def has_signal(signals: Column, kind: str) -> Column:
    """Whether an array of signals has one of a type."""
    return F.exists(signals, lambda s: s["type"] == kind)


def source_filters(tree: dict[str, Any] | None, native: dict[str, str]) -> tuple[list[list[tuple[str, str, Any]]], bool]:
    """Groups of (field, operator, value) that a source can evaluate itself, as an OR of ANDs, and whether the tree must be applied again to what it returns.

    ``native`` maps operators to the source's names.  A condition that has none is left out of its AND group; an OR
    group with such a condition, and one of which nothing is left, lets everything pass.
    """
    groups, residual = [], False
    for g in (tree or {}).get("groups", []):
        known = [(c["field"], native[c["operator"]], c.get("value")) for c in g.get("conditions", []) if c["operator"] in native]
        whole = len(known) == len(g.get("conditions", []))
        residual |= not whole
        if g.get("match", "all") == "all":
            groups.append(known)
        else:
            groups += [[c] for c in known] if whole else [[]]
    if (tree or {}).get("match", "all") == "all" and len(groups) > 1:
        plain = all(g.get("match", "all") == "all" for g in tree["groups"])
        groups, residual = ([[c for g in groups for c in g]], residual) if plain else ([[]], True)
    return ([] if any(not g for g in groups) else groups), residual or not groups


def required_columns(specs: Sequence[dict[str, Any]], id: str = "id") -> list[str]:
    """Columns that rule specifications need: their fields and those their expressions name in backquotes, id first."""
    import re

    named = [id]
    for s in specs:
        named.append(s["field"])
        for rule in s["rules"]:
            named += re.findall(r"`([^`]+)`", f"{rule.get('when', '')} {rule.get('transform', '')}")
    return list(dict.fromkeys(named))
