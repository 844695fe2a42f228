"""Which value survives when records merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.plans.predicates import survivorship as condition


def richness(records: DataFrame, cluster: str, fields: list[str], now) -> DataFrame:
    """3 x contacts + 5 x deals + filled fields + up to 10 for age, and whether the record is its cluster's master (ties: smaller id)."""
    filled = F.size(F.filter(F.array(*(F.col(f).cast("string") for f in fields)), lambda x: x.isNotNull() & (x != "")))
    age = lambda t: F.unix_micros(now) - F.unix_micros(t)
    oldest = F.min("created_at").over(Window.partitionBy(cluster))
    old = F.when(F.col("created_at").isNotNull(), V.round_half_up(age(F.col("created_at")) / age(oldest) * 10)).otherwise(0.0)
    score = 3 * F.coalesce("contacts", F.lit(0)) + 5 * F.coalesce("deals", F.lit(0)) + filled + old
    out = records.withColumn("richness", score)
    return out.withColumn("is_master", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("richness"), "id")) == 1)


def auto_fields(records: DataFrame, cluster: str, fields: list[str], order: list[Column]) -> DataFrame:
    """For each field the master's value, else the first filled one, in the order given."""
    w = Window.partitionBy(cluster).orderBy(*order)
    ranked = records.withColumn("__n", F.row_number().over(w))
    return ranked.groupBy(cluster).agg(F.min_by("id", "__n").alias("master"), *(F.min_by(f, F.when(~V.is_blank(F.col(f)), F.col("__n"))).alias(f) for f in fields))


def choose(rule: str, m: Column, d: Column, m_at: Column | None = None, d_at: Column | None = None, **p) -> Column:
    """Value of a field from master m and duplicate d under one rule; without a reason to change, the master's."""
    order = F.array(*(F.lit(str(x).lower()) for x in p.get("order", []))).cast("array<string>")
    at = lambda c: F.array_position(order, F.lower(c))
    a, b = V.leading_number(m), V.leading_number(d)
    if rule == "never_downgrade":
        return F.when((at(d) > 0) & ((at(m) == 0) | m.isNull() | (at(d) < at(m))), d).otherwise(m)
    if rule == "prefer_nonempty":
        return F.when(V.is_missing(m) & ~V.is_missing(d), d).otherwise(m)
    if rule == "most_recent":
        return F.when(~V.is_missing(d) & (d_at > m_at), d).otherwise(m)
    if rule == "source_preference":
        best = lambda s: F.when(at(s) > 0, at(s)).otherwise(1 << 30)
        return F.when((best(d_at) < best(m_at)) & ~V.is_missing(d), d).otherwise(m)
    if rule == "specific_value":
        return F.when((at(d) > 0) & ((at(m) == 0) | m.isNull() | (at(d) < at(m))), d).otherwise(m)
    if rule == "rollup":
        both = {"max": F.greatest(a, b), "min": F.least(a, b), "sum": F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), "average": F.coalesce((a + b) / 2, a, b)}[p["how"]]
        return F.when(a.isNotNull() | b.isNotNull(), both.cast("string")).otherwise(m.cast("string"))
    if rule == "boolean_union":
        yes = lambda c: F.coalesce(F.lower(c).isin("true", "yes", "1"), F.lit(False))
        return F.when(yes(m) | yes(d), F.lit("true")).otherwise(m)
    if rule == "append":
        sep = p.get("separator", ";")
        parts = F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(sep, m, d), f"[{sep}]"), V.trim), lambda x: x != ""))
        return F.left(F.array_join(parts, sep), F.lit(p.get("most", 65_536)))
    if rule == "prefer_if_populated":
        return F.when((F.coalesce(b, F.lit(0.0)) > 0) & (F.coalesce(a, F.lit(0.0)) <= 0), d).otherwise(m)
    raise ValueError(rule)


def closed_won(pairs: DataFrame, m: str = "m", d: str = "d", won: str = "won") -> DataFrame:
    """The rule closed_won_priority: master and duplicate change places if only the duplicate has a won deal."""
    swap = F.coalesce(F.col(f"{d}.{won}"), F.lit(False)) & ~F.coalesce(F.col(f"{m}.{won}"), F.lit(False))
    return pairs.withColumn("swapped", swap).withColumns({m: F.when(swap, F.col(d)).otherwise(F.col(m)), d: F.when(swap, F.col(m)).otherwise(F.col(d))})


def parent_aware(records: DataFrame, cluster: str, order: list[Column], id: str = "id", parent: str = "parent_id") -> DataFrame:
    """The survivor of each cluster: the first record without a parent, else the first of all, and why."""
    w = Window.partitionBy(cluster).orderBy(F.col(parent).isNotNull(), *order)
    first = records.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return first.select(cluster, F.col(id).alias("survivor"), F.when(F.col(parent).isNull(), "parent_preferred").otherwise("all_have_parents").alias("reason"))


def load_rules(rules: DataFrame, org: str, default: str = "__default__") -> DataFrame:
    """Active rules of an organisation, and the default ones that none of its own replaces on the same field and kind."""
    live = rules.filter("is_active")
    own = live.filter(F.col("org_id") == org)
    return own.unionByName(live.filter(F.col("org_id") == default).join(own.select("field_key", "rule_type").distinct(), ["field_key", "rule_type"], "left_anti"))


def snapshots(clustered: DataFrame, records: DataFrame, fields: list[str], id: str = "id") -> DataFrame:
    """Before a merge: (cluster, id, properties), the filled fields of each member as a map."""
    pairs = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields)), lambda p: ~V.is_missing(p["value"]))
    members = clustered.select("cluster", F.explode("record_ids").alias("__id"))
    return members.join(records.select(F.col(id).alias("__id"), F.map_from_entries(pairs).alias("properties")), "__id").select("cluster", F.col("__id").alias("id"), "properties")


def field_universe(records: DataFrame, cluster: str, properties: str = "properties") -> DataFrame:
    """All keys that any record of a cluster has, sorted."""
    return records.groupBy(cluster).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(properties))))).alias("fields"))


def policy(rule: str, m: Column, d: Column, m_at: Column | None = None, d_at: Column | None = None, order: list[str] | None = None, direction: str = "higher") -> Column:
    """Merge policies: fill_empty, keep_master, append_both, keep_highest, keep_lowest, keep_newest, keep_oldest, keep_most_advanced."""
    a, b = V.leading_number(m), V.leading_number(d)
    listed = F.array(*(F.lit(x.lower()) for x in order or [])).cast("array<string>")
    at = lambda c: F.coalesce(F.array_position(listed, F.lower(c)), F.lit(0))
    further = at(d) > at(m) if direction == "higher" else (at(d) > 0) & (at(d) < at(m))
    return {
        "keep_master": lambda: m, "fill_empty": lambda: F.when(V.is_missing(m), d).otherwise(m), "append_both": lambda: choose("append", m, d),
        "keep_highest": lambda: F.when(b > a, d).otherwise(F.coalesce(m, d)), "keep_lowest": lambda: F.when(b < a, d).otherwise(F.coalesce(m, d)),
        "keep_newest": lambda: F.when(d_at > m_at, F.coalesce(d, m)).otherwise(F.coalesce(m, d)), "keep_oldest": lambda: F.when(d_at < m_at, F.coalesce(d, m)).otherwise(F.coalesce(m, d)),
        "keep_most_advanced": lambda: F.when(further, d).otherwise(m),
    }[rule]()


def fold(rules: list[tuple[str, dict]], m: Column, d: Column, m_at: Column | None = None, d_at: Column | None = None) -> Column:
    """Rules in the order of loading; the last one that changes the value wins."""
    out = m
    for rule, p in rules:
        made = choose(rule, m, d, m_at, d_at, **p)
        out = F.when(~made.eqNullSafe(m), made).otherwise(out)
    return out


def group_winner(groups: list[dict], a: str = "a", b: str = "b") -> Column:
    """First group, by priority, whose conditions hold for exactly one side: "a", "b" or null."""
    out = F.lit(None).cast("string")
    for g in sorted(groups, key=lambda g: -g["priority"]):
        side = lambda x: F.lit(True) if not g["conditions"] else _all([condition(F.col(f"{x}.{c['field']}"), c["operator"], c.get("value")) for c in g["conditions"]])  # noqa: B023, E731
        one, two = side(a), side(b)
        out = F.when(one & ~two, F.lit("a")).when(two & ~one, F.lit("b")).otherwise(out)
    return out


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out &= p
    return out


def merge(records: DataFrame, cluster: str, master: str, never: list[str], union_true: list[str], append: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    """N-way merge of a cluster: excluded fields go, flags unite, lists append, others fill up from the next record."""
    ranked = records.withColumn("__n", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(master), *order)))
    keep = [f for f in fields if f not in {*never, *union_true, *append}]
    listed = lambda f: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~V.is_blank(F.col(f)), F.struct("__n", F.col(f).alias("v"))))), lambda x: x["v"])), ";").alias(f)
    return ranked.groupBy(cluster).agg(
        F.min_by("id", "__n").alias("master"), *(F.min_by(f, F.when(~V.is_blank(F.col(f)), F.col("__n"))).alias(f) for f in keep),
        *(F.bool_or(F.coalesce(F.lower(f).isin("true", "1"), F.lit(False))).alias(f) for f in union_true), *map(listed, append),
    )


def blocked(records: DataFrame, cluster: str, parent: str, won: str) -> DataFrame:
    """Clusters that must not merge: members with different parents, or with a won deal on more than one."""
    return records.groupBy(cluster).agg((F.count_distinct(parent) > 1).alias("different_parents"), (F.count_if(F.col(won)) > 1).alias("won_deals")).withColumn("blocked", F.col("different_parents") | F.col("won_deals"))


def owner(master: Column, other: Column, master_active: Column, other_active: Column, fallback: str | None) -> Column:
    """(owner, how): the master's if active, the other's if active, a fallback, else what there is."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kept = F.coalesce(master, other)
    return (
        F.when(yes(master_active), F.struct(master.alias("owner"), F.lit("kept_active").alias("how"))).when(yes(other_active), F.struct(other.alias("owner"), F.lit("fallback").alias("how")))
        .when(F.lit(fallback is not None), F.struct(F.lit(fallback).cast("string").alias("owner"), F.lit("fallback").alias("how"))).when(kept.isNull(), F.struct(F.lit(None).cast("string").alias("owner"), F.lit("unassigned").alias("how")))
        .otherwise(F.struct(kept.alias("owner"), F.lit("kept_inactive").alias("how")))
    )
