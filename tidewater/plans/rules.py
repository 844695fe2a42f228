"""Rules as data: cascades of conditions and transforms, compiled to Columns.

A specification is a dict (from YAML): id, version, field, sources, on_error
(fail_loud, fail_silent or fail_default), rules [{id, when, transform,
default}] and tests [{input, expected}].  ``when`` and ``transform`` are Spark
SQL expressions over ``$value`` and the record's columns, or, with ``language:
jsonata``, expressions of ``tidewater.plans.expressions``; ``format`` names a
function of the registry below instead.  A file of a rule library, with
``applies_to`` in place of field, is taken as it is: see ``adopted``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions import casing, phone, text

from . import expressions

#: Format functions by key; user code may add to it.
FORMATS: dict[str, Callable[..., Column]] = {
    "e164_phone": lambda c, **p: phone.e164(c, **p), "email_lowercase": text.email_lowercase, "linkedin_url": text.linkedin_url, "numeric_parse": text.numeric_parse, "url_canonical": text.url_canonical,
    "trim_whitespace": text.clean_whitespace, "employee_range": text.employee_range, "extract_domain": text.domain_format, "state_abbreviate": text.state_abbreviate, "country_code_iso2": text.country_code,
    "smart_title_case": casing.smart_title_case,
}
ERRORS = ("fail_loud", "fail_silent", "fail_default")


def load(folder: str) -> dict[str, dict[str, Any]]:
    """All specifications of a folder of YAML files, by id."""
    import yaml

    found = [adopted(yaml.safe_load(p.read_text())) for p in sorted(Path(folder).glob("*.y*ml"))]
    return {s["id"]: checked(s) for s in found}


def adopted(spec: dict[str, Any]) -> dict[str, Any]:
    """A library's specification in the form of this module: its first field's last name, its error policy, its language; others as they are."""
    if "applies_to" not in spec:
        return spec
    to = spec["applies_to"]
    fields = [f.rsplit(".", 1)[-1] for f in to.get("fields", [])]
    policy = {"fail-loud": "fail_loud", "fail-default": "fail_default"}.get(spec.get("on_error"), "fail_silent")
    return {**spec, "field": spec.get("field") or (fields or [""])[0], "fields": fields, "entity": to.get("entity"), "on_error": policy, "language": spec.get("language", "jsonata")}


def checked(spec: dict[str, Any]) -> dict[str, Any]:
    """The specification, or an error that says what is wrong with it."""
    for key in ("id", "version", "field", "rules"):
        if not spec.get(key):
            raise ValueError(f"rule specification without {key}")
    if spec.get("on_error", "fail_silent") not in ERRORS:
        raise ValueError(f"{spec['id']}: on_error is one of {', '.join(ERRORS)}")
    for rule in spec["rules"]:
        if not rule.get("id") or "transform" not in rule and "format" not in rule:
            raise ValueError(f"{spec['id']}: each rule has an id and a transform or a format")
        for part in ("when", "transform") if spec.get("language") == "jsonata" else ():
            if rule.get(part):
                try:
                    expressions.parsed(str(rule[part]).strip())
                except expressions.ExpressionError as x:
                    raise expressions.ExpressionError(f"{spec['id']}/{rule['id']}: {x}") from x
    return spec


def chosen(specs: dict[str, dict[str, Any]], tag: str | None = None, **having: str) -> dict[str, dict[str, Any]]:
    """The specifications with given values of keys such as field, category or entity, and with a tag."""
    return {k: s for k, s in specs.items() if all(s.get(key) == v for key, v in having.items()) and (tag is None or tag in s.get("tags", []))}


def summary(specs: dict[str, dict[str, Any]], key: str) -> Counter:
    return Counter(s.get(key, "") for s in specs.values())


def version_key(v: str) -> tuple[int, ...]:
    """For comparing versions such as 1.10.0."""
    return tuple(int(x) if x.isdigit() else 0 for x in v.lstrip("v").split("-")[0].split("."))


def _written(spec: dict[str, Any], rule: dict[str, Any], name: str, value: Column, kind: str) -> tuple[Column, Column, Column, Column]:
    """(condition, where it fails, result, where that fails) of a rule in the language of its specification."""
    never = F.lit(False)
    if spec.get("language") == "jsonata":
        try:
            made = [expressions.compiled(str(rule[part]), value, kind, lambda c: F.col(c), F.col("source") if spec.get("sources") else None, spec.get("meta")) if rule.get(part) is not None else None for part in ("when", "transform")]
        except expressions.ExpressionError as x:
            raise expressions.ExpressionError(f"{spec['id']}/{rule['id']}: {x}") from x
        when, result = made
        fails = [F.coalesce(n.fails, never) if n is not None and n.fails is not None else never for n in made]
        if result is not None:
            return expressions.condition(when) if when else F.lit(True), fails[0], expressions.result(result), fails[1]
        when = expressions.condition(when) if when else F.lit(True)
    else:
        when, fails = F.expr(rule["when"].replace("$value", f"`{name}`")) if rule.get("when") else F.lit(True), [never]
    result = FORMATS[rule["format"]](value, **rule.get("config", {})) if "format" in rule else F.expr(rule["transform"].replace("$value", f"`{name}`"))
    return F.coalesce(when, never), fails[0], result.cast("string"), result.isNull()


def cascade(spec: dict[str, Any], field: str | None = None, kind: str = "string") -> tuple[Column, Column]:
    """(new value, id of the rule that made it): the first rule whose condition holds.

    With a list of sources, records of another source (column ``source``) stay
    as they are.  Where a condition or a transform fails, fail_silent and
    fail_default go on with the next rule, the latter after the rule's default
    if it has one; fail_loud raises.  A transform in SQL fails where it gives null; one in
    the expression language may give null.  No rule: the value stays.
    """
    name = field or spec["field"]
    if spec.get("language") != "jsonata":
        made = _first(spec, name, F.col(name), kind)
        return made[0], made[1]
    both = V.let(F.col(name), lambda v: F.struct(*(c.alias(n) for c, n in zip(_first(spec, name, v, kind), ("out", "rule")))))  # the value is bound once, however often a rule names it
    return both["out"], both["rule"]


def _first(spec: dict[str, Any], name: str, value: Column, kind: str) -> tuple[Column, Column]:
    mode = spec.get("on_error", "fail_silent")
    out, applied = value.cast("string"), F.lit(None).cast("string")
    allowed = F.coalesce(F.col("source").isin(*spec["sources"]), F.lit(False)) if spec.get("sources") else F.lit(True)
    for rule in reversed(spec["rules"]):
        when, lost, made, failed = _written(spec, rule, name, value, kind)
        holds, wrong = allowed & ~lost & when, lost | when & failed
        if mode == "fail_loud":
            said = F.concat(F.lit(f"{spec['id']}/{rule['id']}: no result for "), F.coalesce(value.cast("string"), F.lit("null")))
            made, fires = F.when(wrong, F.raise_error(said).cast("string")).otherwise(made), allowed & (wrong | when)
        elif mode == "fail_default" and rule.get("default") is not None:
            made, fires = F.when(wrong, F.lit(str(rule["default"]))).otherwise(made), allowed & (wrong | when)
        else:
            fires = holds & ~failed
        out, applied = F.when(fires, made).otherwise(out), F.when(fires, F.lit(rule["id"])).otherwise(applied)
    return out, applied


def chain(records: DataFrame, specs: list[dict[str, Any]], field: str) -> DataFrame:
    """Specifications one after the other on one field, with ``applied``: id@version of those that changed it."""
    out = records.withColumn("__before", F.col(field)).withColumn("applied", F.array().cast("array<string>"))
    for s in specs:
        new, rule = cascade(s, field)
        out = out.withColumn("__new", new).withColumn("__rule", rule)
        mark = F.array(F.lit(f"{s['id']}@{s['version']}"))
        out = out.withColumn("applied", F.when(F.col("__rule").isNotNull() & ~F.col("__new").eqNullSafe(F.col(field)), F.concat("applied", mark)).otherwise(F.col("applied"))).withColumn(field, F.col("__new")).drop("__new", "__rule")
    return out.withColumnRenamed("__before", f"{field}_before")


def changes(records: DataFrame, specs: list[dict[str, Any]], id: str = "id") -> DataFrame:
    """Long rows (id, field, before, after, rule, spec) of what the specifications would change; one pass for all of them."""
    made = []
    for s in specs:
        new, rule = cascade(s)
        made.append(F.struct(F.lit(s["field"]).alias("field"), F.col(s["field"]).cast("string").alias("before"), new.alias("after"), rule.alias("rule"), F.lit(f"{s['id']}@{s['version']}").alias("spec")))
    long = records.select(F.col(id).alias("id"), F.explode(F.array(*made)).alias("c")).select("id", "c.*")
    return long.filter(F.col("before").isNotNull() & F.col("rule").isNotNull() & ~F.col("after").eqNullSafe(F.col("before")))


def apply_all(records: DataFrame, specs: list[dict[str, Any]]) -> DataFrame:
    """Records after all specifications, each on its own field; one projection a specification."""
    for s in specs:
        records = records.withColumn(s["field"], cascade(s)[0])
    return records


def preview(records: DataFrame, specs: list[dict[str, Any]], most: int = 50, id: str = "id") -> DataFrame:
    """The first ``most`` changes by id and field: a report before anything is applied."""
    return changes(records, specs, id).orderBy("id", "field").limit(most)


def apply_selected(records: DataFrame, changed: DataFrame, selected: DataFrame, field: str, id: str = "id", overrides: DataFrame | None = None) -> DataFrame:
    """Records with the selected (id, field) changes of one field; an override (before, value) beats the proposal."""
    own = changed.filter(F.col("field") == field).join(selected.select("id", "field").distinct(), ["id", "field"], "left_semi")
    if overrides is not None:
        own = own.join(overrides.select(F.col("before"), F.col("value").alias("__o")), "before", "left").withColumn("after", F.coalesce("__o", "after"))
    own = own.select(F.col("id").alias("__id"), F.col("after").alias("__after"))
    return records.join(own, F.col(id) == F.col("__id"), "left").withColumn(field, F.coalesce("__after", F.col(field))).drop("__id", "__after")


def rollback(changed: DataFrame) -> DataFrame:
    """id and a map of the values before a run."""
    return changed.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "before")))).alias("properties"))


def melt_status(records: DataFrame, specs: list[dict[str, Any]], id: str = "id") -> DataFrame:
    """One row per record and field: compliant if no rule changes it, unprocessed if blank or no rule applies, else stale."""
    made = []
    for s in specs:
        new, rule = cascade(s)
        value = F.col(s["field"]).cast("string")
        status = F.when(F.coalesce(F.trim(value) == "", F.lit(True)) | rule.isNull(), "unprocessed").when(new.eqNullSafe(value), "compliant").otherwise("stale")
        made.append(F.struct(F.lit(s["field"]).alias("field"), value.alias("raw_value"), new.alias("normalized_value"), F.lit(s["id"]).alias("rule_key"), status.alias("status")))
    return records.select(F.col(id).alias("id"), F.explode(F.array(*made)).alias("c")).select("id", "c.*")


def run_tests(spark: SparkSession, spec: dict[str, Any]) -> list[dict[str, Any]]:
    """The specification's own cases that fail, as the specification gives them and with ``got``; its cases are one small table for each kind of input."""
    failed = []
    cases = list(enumerate(spec.get("tests", [])))
    for kind, of, type_ in (("string", (str, type(None)), "string"), ("boolean", bool, "boolean"), ("number", (int, float), "double")):
        own = [(k, c) for k, c in cases if isinstance(c["input"], of) and (kind == "boolean") == isinstance(c["input"], bool)]
        if own:
            given = [(k, float(c["input"]) if kind == "number" else c["input"]) for k, c in own]
            rows = spark.createDataFrame(given, f"n int, `{spec['field']}` {type_}")
            rows = rows.withColumn("source", F.lit((spec.get("sources") or [""])[0]))
            got = dict(rows.select("n", cascade(spec, kind=kind)[0]).collect())
            failed += [{**c, "got": got[k]} for k, c in own if not _as_expected(c["expected"], got[k])]
    return failed


def _as_expected(expected: Any, got: str | None) -> bool:
    """A result, as text or JSON, against what a case expects; numbers may differ by 1e-4."""
    if isinstance(expected, bool) or expected is None or isinstance(expected, str):
        return got == (expected if not isinstance(expected, bool) else str(expected).lower())
    try:
        return tolerant(expected, json.loads(got or ""))
    except ValueError:
        return False


def tolerant(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(tolerant(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(tolerant, a, b))
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    return abs(a - b) <= 1e-4 if numbers else type(a) is type(b) and a == b
