"""Condition trees compiled to one boolean Column.

A tree is ``{"match": "all"|"any", "groups": [{"match": ..., "conditions":
[{"field", "fieldType", "operator", "value"}]}]}``.  No tree is true; ``all``
of nothing is true, ``any`` of nothing is false.  A leaf is never null, so
three-valued logic does not leak, and Catalyst is free to push the parts down.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import values as V

# Mail domains of persons, not of companies.
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com")


def _listed(x: Any) -> list[str]:
    return [str(v).lower() for v in (x if isinstance(x, (list, tuple)) else [x])]


def _bounds(x: Any) -> tuple[Any, Any]:
    return (x["min"], x["max"]) if isinstance(x, dict) else (x[0], x[1])


def _float(x: Any) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _instant(x: Any) -> Column:
    return F.lit(x) if isinstance(x, (dt.date, dt.datetime)) else F.try_to_timestamp(F.lit(None if x is None else str(x)))


def _personal(c: Column) -> Column:
    return F.lower(F.get(F.split(V.text(c), "@"), F.lit(1))).isin(list(PERSONAL_DOMAINS))


def _string(c: Column, op: str, x: Any) -> Column:
    low, arg = F.lower(V.text(c)), str("" if x is None else x).lower()
    return {
        "equals": lambda: low == arg, "not_equals": lambda: low != arg, "contains": lambda: low.contains(arg), "not_contains": lambda: ~low.contains(arg),
        "starts_with": lambda: low.startswith(arg), "ends_with": lambda: low.endswith(arg), "is_empty": lambda: V.is_blank(c), "is_not_empty": lambda: ~V.is_blank(c),
        "trimmed_equals": lambda: V.trim(low) == arg.strip(), "is_personal_email": lambda: F.coalesce(_personal(c), F.lit(False)), "is_not_personal_email": lambda: ~F.coalesce(_personal(c), F.lit(False)),
    }[op]()


def _number(c: Column, op: str, x: Any, blank_is_zero: bool) -> Column:
    if op in ("is_empty", "is_not_empty"):
        return V.is_missing(c) if op == "is_empty" else ~V.is_missing(c)
    n = V.number(c)
    if blank_is_zero:
        n = F.when(V.is_blank(c), F.lit(0.0)).otherwise(n)
    if op == "between":
        low, high = map(_float, _bounds(x))
        return F.lit(False) if low is None or high is None else n.between(low, high)
    if (arg := _float(x)) is None:
        return F.lit(False)
    return {"equals": n == arg, "not_equals": n != arg, "gt": n > arg, "gte": n >= arg, "lt": n < arg, "lte": n <= arg}[op]


def _enum(c: Column, op: str, x: Any) -> Column:
    low = F.lower(V.text(c))
    return {
        "equals": lambda: low == str(x).lower(), "not_equals": lambda: low != str(x).lower(), "is_any_of": lambda: low.isin(_listed(x)),
        "is_none_of": lambda: ~low.isin(_listed(x)), "is_empty": lambda: V.is_blank(c), "is_not_empty": lambda: ~V.is_blank(c),
    }[op]()


def _bool(c: Column, op: str, x: Any) -> Column:
    t = c.cast("string")
    return {"is_true": t.isin("true", "1"), "is_false": t.isin("false", "0"), "is_empty": V.is_missing(c)}[op]


def _date(c: Column, op: str, x: Any, now: Column) -> Column:
    if op in ("is_empty", "is_not_empty"):
        return V.is_missing(c) if op == "is_empty" else ~V.is_missing(c)
    t = V.timestamp(c)
    if op == "between":
        low, high = map(_instant, _bounds(x))
        return t.between(low, high)
    if op == "in_last_n_days":
        return F.lit(False) if _float(x) is None else t >= now - F.make_dt_interval(F.lit(int(x)))
    at = _instant(x)
    return {"equals": F.to_date(t) == F.to_date(at), "before": t < at, "after": t > at}[op]


def leaf(condition: dict[str, Any], now: Column | None = None, blank_is_zero: bool = False, column: Callable[[str], Column] = F.col) -> Column:
    """One condition; null and failed coercions are false."""
    c, kind, op, x = column(condition["field"]), condition["fieldType"], condition["operator"], condition.get("value")
    now = F.current_timestamp() if now is None else now
    made = {
        "string": lambda: _string(c, op, x), "number": lambda: _number(c, op, x, blank_is_zero), "enum": lambda: _enum(c, op, x),
        "enumeration": lambda: _enum(c, op, x), "bool": lambda: _bool(c, op, x), "date": lambda: _date(c, op, x, now),
    }[kind]()
    return F.coalesce(made, F.lit(False))


def joined(parts: list[Column], match: str) -> Column:
    if not parts:
        return F.lit(match == "all")
    return reduce(and_ if match == "all" else or_, parts)


def compile_tree(tree: dict[str, Any] | None, **how: Any) -> Column:
    """The whole tree as a Column."""
    if tree is None:
        return F.lit(True)
    groups = [joined([leaf(c, **how) for c in g.get("conditions", [])], g.get("match", "all")) for g in tree.get("groups", [])]
    return joined(groups, tree.get("match", "all"))


def columns_of(tree: dict[str, Any] | None) -> list[str]:
    """Fields that a tree refers to, in order."""
    return list(dict.fromkeys(c["field"] for g in (tree or {}).get("groups", []) for c in g.get("conditions", [])))


def condition_count(tree: dict[str, Any] | None) -> int:
    return sum(len(g.get("conditions", [])) for g in (tree or {}).get("groups", []))


# Survivorship conditions: a zero counts as empty.


def populated(c: Column) -> Column:
    return ~V.is_blank(c) & (V.trim(c.cast("string")) != "0")


def survivorship(c: Column, op: str, x: Any = None) -> Column:
    n, arg = V.leading_number(c), _float(x)
    made = {
        "gt": lambda: n > arg, "gte": lambda: n >= arg, "lt": lambda: n < arg, "lte": lambda: n <= arg,
        "eq": lambda: F.lower(V.text(c)) == str(x).lower(), "neq": lambda: F.lower(V.text(c)) != str(x).lower(),
        "is_populated": lambda: populated(c), "is_empty": lambda: ~populated(c), "contains": lambda: F.lower(V.text(c)).contains(str(x).lower()),
    }[op]()
    return F.coalesce(made, F.lit(False))


def owner_condition(c: Column, op: str, listed: list[str]) -> Column:
    """Conditions of assignment rules; text is compared without case."""
    low, own = F.lower(V.text(c)), [x.lower() for x in listed]
    made = {
        "is_one_of": lambda: low.isin(own), "is_not_one_of": lambda: ~low.isin(own), "contains": lambda: joined([low.contains(x) for x in own], "any"),
        "does_not_contain": lambda: ~joined([low.contains(x) for x in own], "any"), "starts_with": lambda: joined([low.startswith(x) for x in own], "any"),
    }[op]()
    return F.coalesce(made, F.lit(False))


def suppression(field: str, op: str, x: Any = None, scope: str = "both", a: str = "a", b: str = "b") -> Column:
    """Conditions between the two records of a pair; own semantics, as only a schema is known.

    ``scope`` is record_a, record_b, both or either, for conditions on one record.
    """
    one, two = F.lower(V.text(F.col(f"{a}.{field}"))), F.lower(V.text(F.col(f"{b}.{field}")))
    if op in ("differs_between", "matches_between"):
        return one != two if op == "differs_between" else one == two
    arg = str(x).lower()
    test = {"is_blank": lambda c: V.trim(c) == "", "is_not_blank": lambda c: V.trim(c) != "", "equals": lambda c: c == arg, "not_equals": lambda c: c != arg, "contains": lambda c: c.contains(arg)}[op]
    return {"record_a": lambda: test(one), "record_b": lambda: test(two), "both": lambda: test(one) & test(two), "either": lambda: test(one) | test(two)}[scope]()
