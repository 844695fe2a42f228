"""Imports: matching rows to records, owners for rows, grouping and assignment."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions.names import email_label, normalize_company_name, string_hash
from tidewater.functions.similarity import jaro_winkler
from tidewater.functions.text import email_lowercase, extract_domain, linkedin_id
from tidewater.plans.predicates import owner_condition
from tidewater.storage import Scratch

from .dedup import SHARED_DOMAINS, composite_similarity
from .lookup import best


def match_contacts(rows: DataFrame, contacts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """row_id to contact: by mail address, else by profile, else, with ``records``, to a company of a similar name; method, confidence and action.

    The third tier is match_companies for the rows that the others leave over.
    """
    mail = lambda c: F.when(email_lowercase(c) != "", email_lowercase(c))
    by_mail = best(rows.select("row_id", mail(F.col("email")).alias("k")).join(contacts.select("id", mail(F.col("email")).alias("k")), "k"), ["row_id"], F.col("id")).select("row_id", F.col("id").alias("__mail"))
    by_profile = best(rows.select("row_id", linkedin_id(F.col("linkedin")).alias("k")).join(contacts.select("id", linkedin_id(F.col("linkedin")).alias("k")), "k"), ["row_id"], F.col("id")).select("row_id", F.col("id").alias("__profile"))
    out = rows.select("row_id").join(by_mail, "row_id", "left").join(by_profile, "row_id", "left")
    how = F.when(F.col("__mail").isNotNull(), "email").when(F.col("__profile").isNotNull(), "linkedin").otherwise("none")
    out = out.select("row_id", F.coalesce("__mail", "__profile").alias("contact_id"), how.alias("method"), F.when(how == "none", 0.0).otherwise(1.0).alias("confidence"))
    if records is None:
        return out
    rest = match_companies(rows.join(out.filter("method = 'none'"), "row_id", "left_semi"), records).select("row_id", F.col("id").alias("company_id"), "score", "action")
    out = out.join(rest, "row_id", "left")
    fuzzy = F.col("action").isin("match", "review")
    return out.select(
        "row_id", "contact_id", F.when(fuzzy, F.col("company_id")).alias("company_id"), F.when(fuzzy, "company_fuzzy").otherwise(F.col("method")).alias("method"),
        F.when(fuzzy, F.col("score")).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("method") != "none", "match").otherwise(F.coalesce("action", F.lit("none"))).alias("action"),
    )


def match_companies(rows: DataFrame, records: DataFrame) -> DataFrame:
    """row_id to the company of highest Jaro-Winkler among those with its mail label or the first three letters of its name.

    From .9 on a match, from .75 on for review, and below .7 for review if the
    domain agrees.  Rows meet as distinct names, and records as distinct names
    with the least id of each.  No score is as high as that of an equal name, so a name
    that a block holds is found by itself; the others meet all names of their blocks.
    """
    norm = lambda c: normalize_company_name(c)
    keys = lambda label, name: F.filter(F.array(F.when(label != "", F.concat(F.lit("d:"), label)), F.when(F.length(name) >= 3, F.concat(F.lit("n:"), F.left(name, F.lit(3))))), lambda x: x.isNotNull())
    own = rows.select("row_id", norm(F.col("company")).alias("x"), email_label(F.col("email")).alias("label"))
    left = own.select("x", "label").distinct().withColumn("k", F.explode(keys(F.col("label"), F.col("x"))))
    domain = F.coalesce(F.get(F.split(extract_domain(F.col("domain")), r"\."), F.lit(0)), F.lit(""))
    right = records.select("id", norm(F.col("name")).alias("y"), domain.alias("host")).groupBy("y", "host").agg(F.min("id").alias("id")).withColumn("k", F.explode(keys(F.col("host"), F.col("y"))))
    same_domain, order = (F.col("label") == F.col("host")).alias("same_domain"), [F.desc("score"), F.desc("same_domain"), F.col("id")]
    scratch = Scratch(rows.sparkSession, "companies")
    equal = left.filter("x <> ''").join(right.withColumn("x", F.col("y")), ["k", "x"]).select("x", "label", "id", same_domain, F.lit(1.0).alias("score"))
    equal = scratch.write(best(equal, ["x", "label"], *order), "equal")
    met = left.join(equal.hint("merge"), ["x", "label"], "left_anti").join(right, "k").select("x", "label", "id", "y", same_domain)
    scores = met.select("x", "y").distinct().withColumn("score", jaro_winkler(F.col("x"), F.col("y")))
    top = best(met.join(scores.hint("merge"), ["x", "y"]), ["x", "label"], *order)
    top = equal.unionByName(top.select(equal.columns))
    how = F.when(F.col("score") >= 0.9, "match").when(F.col("score") >= 0.75, "review").when(F.col("same_domain") & (F.col("score") < 0.7), "review").otherwise("none")
    return own.join(top.hint("merge"), ["x", "label"], "left").select("row_id", "id", "score", F.coalesce(how, F.lit("none")).alias("action"))


def gate(rows: DataFrame, records: DataFrame, least: float = 0.6, weights: dict[str, float] | None = None) -> DataFrame:
    """Before a write: upsert, insert, review or skip, with the target, how similar the best candidate is, and a warning.

    Candidates are records of the same domain (mail providers and networks are nobody's) or, without any, of the same
    normalized name; the most similar by the weights counts, itself left out.  A row that says which record it is
    (known_id) is an upsert of it: from ``least`` on the candidate is named in a warning, unless one is the other's
    parent; else it has no score.  Of other rows, a candidate that is somebody's child (parent_id) makes a skip, as the
    row may mean the parent; from ``least`` on it goes to review, else the row is new.
    """
    fields = ("name", "domain", "phone", "industry", "employees")
    keyed = lambda df, *keep: df.select(*keep, extract_domain(F.col("domain")).alias("host"), normalize_company_name(F.col("name")).alias("plain")).withColumn("host", F.when(~F.col("host").isin(*SHARED_DOMAINS), F.col("host")))
    own = keyed(rows, "row_id", "known_id", F.struct(*fields).alias("a"))
    own = own.join(records.select(F.col("id").alias("known_id"), F.col("parent_id").alias("known_parent")), "known_id", "left")
    other = keyed(records, "id", "parent_id", F.struct(*fields).alias("b"))
    by_domain = own.drop("plain").join(other.drop("plain"), "host").drop("host")
    rest = own.filter("plain <> ''").join(by_domain.select("row_id").distinct(), "row_id", "left_anti")
    met = by_domain.unionByName(rest.drop("host").join(other.drop("host"), "plain").drop("plain")).filter(~F.col("id").eqNullSafe(F.col("known_id")))
    scored = met.withColumn("score", V.round_half_up(composite_similarity(F.col("a"), F.col("b"), weights), 6))
    top = best(scored, ["row_id"], F.desc("score"), F.col("id")).select("row_id", "id", "parent_id", "score", F.col("b.name").alias("rival"))
    out = own.select("row_id", "known_id", "known_parent").join(top, "row_id", "left")
    known, near = F.col("known_id").isNotNull(), F.coalesce(F.col("score") >= least, F.lit(False))
    linked = F.coalesce(F.col("known_parent") == F.col("id"), F.lit(False)) | F.coalesce(F.col("parent_id") == F.col("known_id"), F.lit(False))
    action = F.when(known, "upsert").when(F.col("id").isNull(), "insert").when(F.col("parent_id").isNotNull(), "skip").when(near, "review").otherwise("insert")
    target = F.when(known, F.col("known_id")).when(action.isin("skip", "review"), F.col("id"))
    warned = known & near & ~linked
    per_cent = V.round_half_up(F.col("score") * 100).cast("int").cast("string")
    warning = F.when(warned, F.concat(F.lit("Potential duplicate found: "), V.text(F.col("rival")), F.lit(" ("), per_cent, F.lit("% similar)"))).when(
        action == "skip", F.concat(F.lit("Parent-child suppression: matched company "), F.col("id").cast("string"), F.lit(" is a child of "), F.col("parent_id").cast("string"), F.lit(". Manual review required.")))
    return out.select("row_id", action.alias("action"), target.alias("id"), F.when(~known | warned, F.col("score")).alias("score"), warning.alias("warning"))


def write_plan(rows: DataFrame, gated: DataFrame, size: int = 100) -> DataFrame:
    """The rows to write, by action and in numbered batches of ``size``; those for review or skipped have no batch."""
    planned = rows.join(gated.select("row_id", "action", F.col("id").alias("target_id")), "row_id")
    writes = F.col("action").isin("upsert", "insert")
    place = F.row_number().over(Window.partitionBy("action").orderBy("row_id"))
    return planned.withColumn("batch", F.when(writes, F.floor((place - 1) / size)))


def owner_of(rules: list[dict], key: Column, weights: dict[str, int] | None = None) -> Column:
    """Owner by the first rule (lowest priority number) whose conditions all hold, else dealt out by a hash over weights, else null."""
    out = F.lit(None).cast("string")
    if weights:
        dealt = [o for o, w in weights.items() for _ in range(w)]
        out = F.get(F.array(*map(F.lit, dealt)), F.pmod(F.abs(string_hash(key)), F.lit(len(dealt))).cast("int"))
    for rule in sorted(rules, key=lambda r: -r["priority"]):
        every = F.lit(True)
        for c in rule["conditions"]:
            every &= owner_condition(F.col(c["field"]), c["operator"], c["values"])
        out = F.when(every, F.lit(rule["owner"])).otherwise(out)
    return out


def group_key(company: Column, email: Column, row: Column) -> Column:
    """What rows of one company share: label of the mail domain, else the normalized name, else the row itself."""
    label, name = email_label(email), normalize_company_name(company)
    return F.when(label != "", F.concat(F.lit("domain:"), label)).when(name != "", F.concat(F.lit("name:"), name)).otherwise(F.concat(F.lit("row:"), row.cast("string")))


def ranked(rows: DataFrame, by: list[str], key: str, scratch: Scratch) -> DataFrame:
    """The rows with ``rank`` from 1 by key inside each group.  Ranges of (group, key) are ranked by tasks of their own, so one large group fills none."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(rows.repartitionByRange(parts, *by, key).withColumn("__part", F.spark_partition_id()), "placed")
    counts = placed.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), earlier.alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = placed.join(offsets, reduce(and_, [F.col("__part") == F.col("__p"), *same]))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(key)) + F.col("__before")).select(*rows.columns, "rank")


def rotations(target: list[Fraction], have: list[Fraction], n: int, m: int) -> list[tuple[int, int, list[int]]]:
    """Who gets m groups of n, one after the other, each for the owner furthest below the target (ties: the first): (from, to, owners in turn), ranks from 1.

    Owners that the next round reaches take turns in one order until another
    one is as far below, so there are few stretches whatever m is.  ``have`` is brought up to date.
    """
    out, rank = [], 1
    while rank <= m:
        gap = [t - h for t, h in zip(target, have)]
        order = sorted(range(len(gap)), key=lambda o: (-gap[o], o))
        top = order[0]
        turn = [o for o in order if (-gap[o], o) < (n - gap[top], top)] or [top]
        rounds = m  # at most
        for x in order[len(turn) :]:
            last = turn[-1]
            behind = (gap[last] - gap[x]) / n  # whole rounds after which the last one in turn is level with x
            rounds = min(rounds, max(1, int(behind) + (1 if behind != int(behind) or last < x else 0)))
        taken = min(m - rank + 1, rounds * len(turn))
        for k, o in enumerate(turn):
            have[o] += n * (taken // len(turn) + (k < taken % len(turn)))
        out.append((rank, rank + taken - 1, turn))
        rank += taken
    return out


def assign_groups(groups: DataFrame, shares: dict[str, float], by: str | None = None) -> DataFrame:
    """Groups (key, n) to owners: largest first, to the owner furthest below the target; equal ones by key.

    Each step needs the one before, but groups of one size are dealt in few
    stretches of turns.  So only the number of groups of each size goes
    through one task for each value of ``by`` (a campaign, say); the groups
    themselves are ranked in ranges and find their stretch by a join.  Sizes
    are above 0.
    """
    scratch = Scratch(groups.sparkSession, "assign")
    keys, names = [by] if by else [], list(shares)
    sizes = groups.groupBy(*keys, "n").agg(F.count("*").alias("m"))
    share = [Fraction(str(shares[o])) for o in names]
    share = [x / sum(share) for x in share]

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ascending=False)
        total, have, out = int((rows["n"] * rows["m"]).sum()), [Fraction(0)] * len(share), []
        for n, m in zip(rows["n"].tolist(), rows["m"].tolist()):
            for a, b, turn in rotations([total * x for x in share], have, int(n), int(m)):
                out.append((n, a, b, [names[o] for o in turn]))
        made = pd.DataFrame(out, columns=["__size", "__from", "__to", "__turn"])
        return made.assign(__by=rows[by].iloc[0])[["__by", *made.columns]] if by else made

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    schema = (f"__by {kinds[by]}, " if by else "") + f"__size {kinds['n']}, __from bigint, __to bigint, __turn array<string>"
    stretches = sizes.groupBy(*keys).applyInPandas(deal, schema)
    own = ranked(groups.select(*keys, "key", "n"), [*keys, "n"], "key", scratch)
    met = (F.col("n") == F.col("__size")) & F.col("rank").between(F.col("__from"), F.col("__to"))
    if by:
        met &= F.col(by).eqNullSafe(F.col("__by"))
    owner = F.get("__turn", F.pmod(F.col("rank") - F.col("__from"), F.size("__turn")).cast("int"))
    return own.join(stretches, met).select(*keys, "key", "n", owner.alias("owner"))
