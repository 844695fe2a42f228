"""Records between systems: domains and routes, structured values, enums, dates as labels, limits of use."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from tidewater import values as V

# What a domain looks like, and the ranges of an employee enum.
DOMAIN = r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{0,61}[a-z0-9]$"
EMPLOYEE_ENUM = ((1, "1"), (10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000"), (10000, "5001-10000"), (float("inf"), "10001+"))
PAID, UNLIMITED = ("starter", "growth", "scale", "enterprise"), ("internal", "exempt")


def clean_domain(c: Column) -> Column:
    """Host in small letters without scheme, www., path, query and a dot at the end; null if nothing is left."""
    t = F.regexp_replace(F.lower(V.trim(c.cast("string"))), r"^https?://", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^www\.", ""), r"[/?].*$", ""), r"\.$", "")
    return F.when(t != "", t)


def valid_domain(c: Column) -> Column:
    """The clean domain if it looks like one, else null."""
    return V.let(clean_domain(c), lambda d: F.when(d.rlike(DOMAIN), d))


def company_domain(domain: Column, website: Column, additional: Column) -> Column:
    """The first valid one of the domain, the website and the comma-separated additional domains."""
    more = F.filter(F.transform(F.split(V.text(additional), ","), valid_domain), lambda d: d.isNotNull())
    return F.coalesce(valid_domain(domain), valid_domain(website), F.get(more, F.lit(0)))


def location(*parts: Column) -> Column:
    """City, state and country, as far as filled, joined by commas; null without any."""
    joined = F.concat_ws(", ", *(F.when(~V.is_blank(p), V.trim(p)) for p in parts))
    return F.when(joined != "", joined)


def route(domain: Column, name: Column) -> Column:
    """domain-based with a domain, name-based with a name only, else insufficient."""
    return F.when(domain.isNotNull(), "domain-based").when(~V.is_blank(name), "name-based").otherwise("insufficient")


def extract_output(c: Column, wanted: str, default: str | None) -> Column:
    """One entry of a structured value, a JSON object: the wanted key, else the declared default, else the first entry.  Text that is no object is returned as it is."""
    fields = F.from_json(c, "map<string,string>")
    keys = [k for k in (None if wanted in ("", "default") else wanted, default) if k]
    first = F.get(F.map_values(fields), F.lit(0))
    is_object = V.trim(c).startswith("{") & fields.isNotNull()
    return F.when(is_object, F.coalesce(*(fields[k] for k in keys), first, F.lit(""))).otherwise(c)


def enum_value(c: Column, values: dict[str, str], mapped: dict[str, str] | None = None) -> Column:
    """(valid, value, reason) of a value for an enum of value to label.

    An explicit mapping decides, even if it leads nowhere; then the value
    itself, then a label without case.  Without values everything is valid.
    """
    row = lambda ok, v, why: F.struct(F.lit(ok).alias("valid"), v.cast("string").alias("value"), F.lit(why).cast("string").alias("reason"))
    none = F.lit(None)
    if not values:
        return row(True, none, None)
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    labels = table({label.lower(): v for v, label in reversed(values.items())})[F.lower(c)]
    out = F.when(c.isin(*values), row(True, none, None)).when(labels.isNotNull(), row(True, labels, "enum_translated")).otherwise(row(False, none, "enum_mismatch"))
    if mapped:
        to = table(mapped)[c]
        out = F.when(to.isin(*values), row(True, to, "enum_translated")).when(to.isNotNull(), row(False, none, "enum_mismatch")).otherwise(out)
    return out


def employee_enum(c: Column, values: list[str] | None = None) -> Column:
    """The first range that holds the count and is one of the values, else the last value; without values the count itself."""
    if not values:
        return c.cast("string")
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for top, label in EMPLOYEE_ENUM:
        if label in values:
            out = out.when(c <= top, label)
    return out.otherwise(values[-1])


def date_label(c: Column, now: Column) -> Column:
    """TODAY, YESTERDAY or the date as JUNE 5, 2026, by the days of the session's zone."""
    days = F.datediff(F.to_date(now), F.to_date(c))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(days <= 0, "TODAY").when(days == 1, "YESTERDAY").otherwise(F.upper(F.date_format(c, "MMMM d, yyyy")))


def short_date(c: Column) -> Column:
    """Jun 6, 2026."""
    return F.date_format(c, "MMM d, yyyy")


def short_timestamp(c: Column) -> Column:
    """Jun 6, 4:59 AM."""
    return F.date_format(c, "MMM d, h:mm a")


def camel_key(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), name)


def camel_keys(df: DataFrame) -> DataFrame:
    """Column names from snake_case to camelCase."""
    return df.toDF(*map(camel_key, df.columns))


def nearly_equal(a: Column, b: Column, kind: DataType, tolerance: float = 1e-4) -> Column:
    """Whether two values of one type are equal, numbers within a tolerance, arrays, maps and structs entry by entry; null equals null."""
    both, either = a.isNull() & b.isNull(), a.isNull() | b.isNull()
    if isinstance(kind, NumericType):
        x, y = a.cast("double"), b.cast("double")
        special = F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
        same = F.when(special, x == y).otherwise(F.abs(x - y) <= tolerance)
    elif isinstance(kind, ArrayType):
        same = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: nearly_equal(x, y, kind.elementType, tolerance)), lambda x: x)
    elif isinstance(kind, MapType):
        same = (F.size(a) == F.size(b)) & F.forall(F.map_keys(a), lambda k: F.map_contains_key(b, k) & nearly_equal(F.element_at(a, k), F.element_at(b, k), kind.valueType, tolerance))
    elif isinstance(kind, StructType):
        same = F.lit(True)
        for f in kind.fields:
            same &= nearly_equal(a[f.name], b[f.name], f.dataType, tolerance)
    else:
        assert isinstance(kind, (StringType, BooleanType, DataType))
        same = a == b
    return F.when(both, True).when(either, False).otherwise(same)


def flat_record(records: DataFrame, mapping: dict[str, str], numeric: tuple[str, ...] = (), prefix: str = "crm_", id: str = "id") -> DataFrame:
    """CRM columns under their canonical names, numeric ones by their digits; columns without a name of ours get a prefix; id and a label first."""
    number = lambda c: F.regexp_replace(c.cast("string"), "[^0-9.-]", "").try_cast("double")
    label = F.coalesce(*(F.when(~V.is_missing(F.col(c)), F.col(c)) for c in ("name", "domain") if c in records.columns), F.col(id).cast("string"))
    named = [(number(F.col(c)) if mapping[c] in numeric else F.col(c)).alias(mapping[c]) if c in mapping else F.col(c).alias(prefix + c) for c in records.columns if c != id]
    return records.select(F.col(id).alias("_id"), label.alias("_label"), *named)


def may_act(tier: Column, status: Column, grace_expired: Column, trial_days: Column, remaining: Column, quantity: Column) -> Column:
    """Whether a plan lets an action of some quantity pass: by tier, payment, grace period and, on trial, what remains."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(tier.isNull(), False).when(tier.isin(*UNLIMITED), True).when(yes(status == "cancelled"), False).when(yes(grace_expired), False)
        .when(tier.isin(*PAID), yes(status.isin("active", "past_due")))
        .when(tier == "trial", (F.coalesce(trial_days, F.lit(0)) > 0) & (F.coalesce(remaining, F.lit(0)) >= quantity)).otherwise(False)
    )


def segments(rows: DataFrame, visible: str = "visible", order: str = "order") -> DataFrame:
    """The visible segments in their order."""
    return rows.filter(F.coalesce(F.col(visible), F.lit(True))).orderBy(order)
