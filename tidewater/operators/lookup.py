"""Lookups of free text in reference lists: exact, fuzzy, by sound, and cascades of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions.similarity import jaccard, trigrams
from tidewater.functions.sounds import double_metaphone
from tidewater.storage import Scratch

#: Parts in which rows of one trigram are joined with its number.
PARTS = 16


def _low(c: Column) -> Column:
    return V.trim(F.lower(c))


def best(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order given."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def active(reference: DataFrame, org: str | None) -> DataFrame:
    """Active rows of an organisation and of all."""
    own = F.col("org_id").isNull() if org is None else (F.col("org_id").isNull() | (F.col("org_id") == org))
    return reference.filter(own & F.col("is_active"))


def lookup(values: DataFrame, reference: DataFrame, org: str | None = None, threshold: float = 0.8, sounds: bool = False) -> DataFrame:
    """(value, canonical, match_type, confidence) for each distinct value of the only column.

    Tiers in turn, each for what the one before left over: equal text, trigram
    similarity from the threshold on, equal sound (first code of double metaphone; texts without a sound match nothing).
    The latter two look at rows that are fuzzy_eligible only.  What the first two have found is
    stored, as the next one and the result read it; values, of which there may be
    many that compress well, are never broadcast.  The organisation's row
    beats the common one.  The fuzzy tier meets only rows that share a trigram
    and whose numbers of trigrams allow the threshold.
    """
    scratch = Scratch(values.sparkSession, "lookup")
    values = scratch.write(values.toDF("value").filter("value IS NOT NULL").distinct(), "values")
    ref = active(reference, org).select(F.col("input_value").alias("ref"), F.col("canonical_value").alias("canonical"), "org_id", "fuzzy_eligible")
    own_first = F.col("org_id").asc_nulls_last()
    known = best(ref.withColumn("__low", _low(F.col("ref"))), ["__low"], own_first, F.col("canonical")).select("__low", "canonical", F.lit("exact").alias("match_type"), F.lit(100).alias("confidence"))
    tried = scratch.write(values.withColumn("__low", _low(F.col("value"))).join(known, "__low", "left").drop("__low"), "exact")
    exact, rest = tried.filter("match_type IS NOT NULL"), tried.filter("match_type IS NULL").select("value")
    fuzzy = scratch.write(fuzzy_lookup(rest, ref.filter("fuzzy_eligible"), threshold), "fuzzy")
    found, rest = exact.unionByName(fuzzy), rest.join(fuzzy.hint("merge"), "value", "left_anti")
    if sounds:
        sound = lambda rows, c: rows.withColumn("s", double_metaphone(F.col(c))["first"]).filter("s <> ''")
        sounding = sound(ref.filter("fuzzy_eligible"), "ref").groupBy("s").agg(F.min(F.struct(F.col("org_id").isNull().alias("common"), "org_id", "canonical")).alias("r"))  # one row answers for all that sound alike
        heard = rest.withColumn("s", double_metaphone(F.col("value"))["first"]).join(sounding, "s", "left")
        return found.unionByName(heard.select("value", F.col("r.canonical").alias("canonical"), F.when(F.col("r").isNotNull(), "phonetic").otherwise("none").alias("match_type"), F.when(F.col("r").isNotNull(), 65).otherwise(0).alias("confidence")))
    return found.unionByName(rest.select("value", F.lit(None).cast("string").alias("canonical"), F.lit("none").alias("match_type"), F.lit(0).alias("confidence")))


def fuzzy_lookup(values: DataFrame, ref: DataFrame, threshold: float) -> DataFrame:
    """The most similar reference row of each value by trigrams, from the threshold on.

    Prefix filter: in one order of all trigrams, the rarest first, two sets that
    overlap by the threshold share one of their first |set| - ceil(threshold x
    |set|) + 1.  So common trigrams make no pairs, only these meet, as ids, and
    the sets are compared afterwards.  Trigrams of rows are many times as large as the
    files they are estimated by, so they are always joined by merge.
    """
    left = values.select("value", trigrams(F.col("value")).alias("a")).withColumn("x", F.xxhash64("value"))
    right = ref.select("ref", "canonical", "org_id", trigrams(F.col("ref")).alias("b")).withColumn("y", F.xxhash64("ref", "canonical", "org_id"))
    tokens = lambda rows, of, id: rows.select(F.col(id).alias("id"), F.size(of).alias("size"), F.explode(of).alias("g"))
    left_tokens, right_tokens = tokens(left, "a", "x"), tokens(right, "b", "y").distinct()
    seen = left_tokens.select("g").unionByName(right_tokens.select("g")).groupBy("g").agg(F.count("*").alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def prefix(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("id").orderBy("n", "g"))
        return rows.withColumn("part", F.pmod("id", F.lit(PARTS)).cast("int")).hint("merge").join(seen, ["g", "part"]).drop("part").withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)

    met = prefix(left_tokens).select("g", F.col("id").alias("x"), F.col("size").alias("p")).hint("merge").join(prefix(right_tokens).select("g", F.col("id").alias("y"), F.col("size").alias("q")), "g")
    met = met.filter((F.col("p") >= threshold * F.col("q")) & (F.col("q") >= threshold * F.col("p"))).select("x", "y").distinct()
    scored = met.join(left.select("value", "x").hint("merge"), "x").join(right.drop("b"), "y").withColumns({"a": trigrams(F.col("value")), "b": trigrams(F.col("ref"))})
    scored = scored.withColumn("sim", jaccard(F.col("a"), F.col("b"))).filter(F.col("sim") >= threshold)
    top = best(scored, ["value"], F.desc("sim"), F.col("org_id").asc_nulls_last(), F.col("canonical"), F.col("ref"))
    return top.select("value", "canonical", F.lit("fuzzy").alias("match_type"), F.round(F.col("sim") * 100).cast("int").alias("confidence"))


def apply_lookup(records: DataFrame, field: str, reference: DataFrame, id: str = "id", **how) -> DataFrame:
    """Changes that a lookup makes: id, field, before, after, match_type, confidence, requires_review."""
    found = lookup(records.select(field).filter(~V.is_blank(F.col(field))), reference, **how).filter("canonical IS NOT NULL")
    joined = records.select(F.col(id).alias("id"), F.col(field).alias("before")).join(found, F.col("before") == F.col("value"))
    changed = joined.filter(F.col("before") != F.col("canonical"))
    return changed.select("id", F.lit(field).alias("field"), "before", F.col("canonical").alias("after"), "match_type", "confidence", (F.col("match_type") != "exact").alias("requires_review"))


def registry_lookup(tokens: DataFrame, registry: DataFrame, org: str) -> DataFrame:
    """Active registry entries: the organisation's, else the common one."""
    live = registry.filter("status = 'active'").select("input_token", "canonical_form", "org_id")
    mine = live.filter(F.col("org_id") == org).select(F.col("input_token").alias("token"), F.col("canonical_form").alias("__mine"))
    common = live.filter("org_id IS NULL").select(F.col("input_token").alias("token"), F.col("canonical_form").alias("__common"))
    return tokens.toDF("token").distinct().join(mine, "token", "left").join(common, "token", "left").select("token", F.coalesce("__mine", "__common").alias("canonical_form"), F.when(F.col("__mine").isNotNull(), "org").when(F.col("__common").isNotNull(), "global").alias("scope"))


def crosswalk(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (key, naics_code, naics_label, provider_label) to a value: by code, else by label, else by the provider's label."""
    once = lambda on, name: best(table.filter(F.col(on).isNotNull()).withColumn("__k", F.lower(on)), ["__k"], F.col("naics_code")).select(F.col("__k").alias(f"__{name}"), F.col("crm_value").alias(name))
    out = rows
    for on, source, name in (("naics_code", "naics_code", "by_code"), ("naics_label", "naics_label", "by_label"), ("source_label", "provider_label", "by_provider")):
        out = out.join(once(on, name), F.lower(F.col(source)) == F.col(f"__{name}"), "left").drop(f"__{name}")
    how = F.when(F.col("by_code").isNotNull(), "naics_code").when(F.col("by_label").isNotNull(), "naics_label").when(F.col("by_provider").isNotNull(), "provider_label").otherwise("miss")
    return out.select(*rows.columns, F.coalesce("by_code", "by_label", "by_provider").alias("value"), how.alias("matched_by"))


def classify_compound(values: DataFrame, reference: DataFrame, separators: str = r"\s*[,;/&|]\s*", **how) -> DataFrame:
    """A value as a whole, else its first part that the lookup knows."""
    scratch = Scratch(values.sparkSession, "compound")
    values = scratch.write(values.toDF("value").filter("value IS NOT NULL").distinct(), "values")
    whole = scratch.write(lookup(values, reference, **how).filter("canonical IS NOT NULL"), "whole")
    parts = scratch.write(values.join(whole, "value", "left_anti").select("value", F.posexplode(F.split("value", separators)).alias("at", "part")).filter("part <> ''"), "parts")
    known = lookup(parts.select("part"), reference, **how).filter("canonical IS NOT NULL").withColumnRenamed("value", "part")
    first = scratch.write(best(parts.join(known, "part"), ["value"], F.col("at")).select("value", "canonical", F.concat(F.lit("part_"), F.col("match_type")).alias("match_type"), "confidence"), "first")
    out = whole.unionByName(first)
    return out.unionByName(values.join(out, "value", "left_anti").select("value", F.lit(None).cast("string").alias("canonical"), F.lit("none").alias("match_type"), F.lit(0).alias("confidence")))


def unmapped(values: DataFrame, mapped: DataFrame, rejected: DataFrame) -> DataFrame:
    """Distinct values that are neither mapped nor rejected."""
    out = values.toDF("value").distinct()
    for known in (mapped, rejected):
        out = out.join(known.toDF("value"), "value", "left_anti")
    return out


def mark_known(rows: DataFrame, known: DataFrame, key: str, flag: str = "in_crm") -> DataFrame:
    """A flag whether the row's key is in the other table."""
    there = known.select(F.col(known.columns[0]).alias("__k")).distinct().withColumn("__there", F.lit(True))
    return rows.join(there, F.col(key) == F.col("__k"), "left").withColumn(flag, F.coalesce("__there", F.lit(False))).drop("__k", "__there")


def relationship(pairs: DataFrame, records: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """How the two records of a pair (a, b) stand to each other by their parents."""
    side = lambda x: records.select(F.col(id).alias(x), F.col(parent).alias(f"{x}_parent"))
    p, q = F.col("a_parent"), F.col("b_parent")
    kind = F.when((p == F.col("b")) | (q == F.col("a")), "directly_linked").when(p == q, "same_parent").when(p.isNotNull() & q.isNotNull(), "sibling").when(p.isNotNull() | q.isNotNull(), "one_has_parent").otherwise("no_hierarchy")
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("relationship", kind)


def as_of(rows: DataFrame, by: list[str], value: str, at: str, when) -> DataFrame:
    """The latest value of each group on or before an instant."""
    return rows.filter(F.col(at) <= when).groupBy(*by).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def child_table(records: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, parent_id) of the records that have a parent."""
    return records.filter(F.col(parent).isNotNull()).select(F.col(id).alias("id"), F.col(parent).alias("parent_id"))


def key_index(records: DataFrame, keys: dict[str, Column], id: str = "id") -> DataFrame:
    """(kind, key, id): one row for each filled key of each record, the record of smallest id for each key."""
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key")) for kind, c in keys.items()))
    long = records.select(F.col(id).alias("id"), F.explode(made).alias("k")).select("k.kind", "k.key", "id")
    return long.filter(~V.is_blank(F.col("key"))).groupBy("kind", "key").agg(F.min("id").alias("id"))


def by_code(codes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Codes of four or six digits to the key of a taxonomy (key, code_4, codes_6); of several the smallest key."""
    short = taxonomy.select("key", F.col("code_4").alias("code"))
    long = taxonomy.select("key", F.explode("codes_6").alias("code"))
    known = short.unionByName(long).groupBy("code").agg(F.min("key").alias("key"))
    return codes.toDF("code").distinct().join(known, "code", "left")


def taxonomy_search(taxonomy: DataFrame, words: str, fields: list[str]) -> DataFrame:
    """Rows whose fields, taken together, contain the words, without case."""
    whole = F.lower(F.concat_ws(" ", *(F.col(f) for f in fields)))
    return taxonomy.filter(whole.contains(words.lower()))


def ilike_any(rows: DataFrame, fields: list[str], words: str) -> DataFrame:
    """Rows with the words in any of the fields, without case; % and _ are plain characters."""
    pattern = "%" + words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.col(f).ilike(pattern), F.lit(False))
    return rows.filter(hit)


def field_conflicts(rules: DataFrame, assigned: DataFrame, org: str) -> DataFrame:
    """Active rules (id, name, org_id, is_active) of an organisation or of all that write the same field (rule_id, field): one row a rule, field and other rule."""
    live = rules.filter(F.col("is_active") & (F.col("org_id").isNull() | (F.col("org_id") == org)))
    own = assigned.join(live.select(F.col("id").alias("rule_id"), "name"), "rule_id").distinct()
    other = own.select(F.col("rule_id").alias("other_id"), F.col("name").alias("other_name"), "field")
    return own.join(other, "field").filter("rule_id <> other_id").select("rule_id", "field", "other_id", "other_name")


def with_latest(rows: DataFrame, facts: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """The latest facts of each key joined to the rows; without facts 0."""
    last = facts.groupBy(F.col(key).alias("__key")).agg(*(F.max_by(v, at).alias(v) for v in values))
    out = rows.join(last, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def field_sources(records: DataFrame, sources: DataFrame, fields: list[str], id: str = "id", lead: str = "source_") -> DataFrame:
    """Records with one column a field that says where its value came from, from rows (id, field, source); the last name wins where there are several."""
    wide = sources.filter(F.col("field").isin(fields)).groupBy(F.col("id").alias("__id")).agg(*(F.max(F.when(F.col("field") == f, F.col("source"))).alias(f"{lead}{f}") for f in fields))
    return records.join(wide, F.col(id) == F.col("__id"), "left").drop("__id")
