"""Entity resolution: blocking keys, candidate pairs, pair scores, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions.names import EMPLOYEE_BANDS
from tidewater.functions.phone import digits
from tidewater.functions.similarity import jaro_winkler, similarity
from tidewater.functions.text import email_lowercase, extract_domain, linkedin_id
from tidewater.storage import Scratch

from .components import connected_components

# Domains of mail providers and networks, which say nothing about a company.
SHARED_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "live.com", "msn.com", "me.com",
    "linkedin.com", "facebook.com", "twitter.com", "instagram.com", "google.com", "youtube.com", "github.com", "wix.com", "wordpress.com", "squarespace.com",
)
# A .com domain and one of these are often two firms.
NATIONAL_ENDS = (".com.au", ".co.uk", ".co.nz", ".ca", ".ie")
GRADES = {"A": 95, "B": 80, "C": 65}


def company_keys(name: Column, domain: Column, phone: Column, linkedin: Column, excluded: tuple[str, ...] = SHARED_DOMAINS) -> Column:
    """Blocking keys as an array of (kind, key): domain, linkedin slug, first seven digits of the phone, first four characters of the name."""
    made = F.struct(extract_domain(domain).alias("d"), linkedin_id(linkedin).alias("l"), digits(phone).alias("p"), F.regexp_replace(F.lower(V.text(name)), "[^a-z0-9]", "").alias("n"))
    return V.let(made, lambda m: keys_of(m["d"], m["l"], m["p"], m["n"], excluded))


def keys_of(host: Column, profile: Column, number: Column, letters: Column, excluded: tuple[str, ...] = SHARED_DOMAINS) -> Column:
    """company_keys of what is made of a record: host, profile, digits of the phone, letters and digits of the name."""
    key = lambda kind, value, when: F.when(when & value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("key")))
    keys = F.array(key("domain", host, ~host.isin(list(excluded))), key("linkedin", profile, F.lit(True)), key("phone", F.left(number, F.lit(7)), F.length(number) >= 7), key("name", F.left(letters, F.lit(4)), F.length(letters) >= 4))
    return F.filter(keys, lambda x: x.isNotNull())


def contact_keys(email: Column, phone: Column, linkedin: Column) -> Column:
    """Blocking keys of persons: mail address, first six of at least seven digits, profile."""
    p, e = digits(phone), email_lowercase(email)
    key = lambda kind, value, when: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), value.alias("key")))
    return F.filter(F.array(key("email", e, e != ""), key("phone", F.left(p, F.lit(6)), F.length(p) >= 7), key("linkedin", linkedin_id(linkedin), F.lit(True) & linkedin_id(linkedin).isNotNull())), lambda x: x.isNotNull())


def candidate_pairs(records: DataFrame, keys: Column, id: str = "id", changed: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a key; one shuffle on keys for all kinds.

    With ``changed``, a table of ids, only pairs with such an id (the
    incremental form).  The pairs of a block are what is asked for, so their
    number is the operator's result; adaptive execution splits hot keys.
    """
    return pairs_of(index_of(records.select(F.col(id).alias("id"), keys.alias("keys"))), changed)


def index_of(keyed: DataFrame, keys: str = "keys") -> DataFrame:
    """(id, kind, key) of records with an array of keys; the outer form asks for no filter, for which Spark would make the keys again."""
    return keyed.select("id", F.explode_outer(keys).alias("k")).select("id", "k.kind", "k.key")


def ordered_keys(keys: Column) -> Column:
    """Keys (kind, key) as distinct texts in one order for all records."""
    return F.sort_array(F.array_distinct(F.transform(keys, lambda k: F.concat(k["kind"], F.lit("\0"), k["key"]))), asc=False)


def entries(held: DataFrame, keys: str = "held") -> DataFrame:
    """One row for each key in place of the ordered keys: ``k`` and those before it, ``earlier``."""
    rows = held.select("*", F.posexplode(keys).alias("__at", "k"))
    return rows.withColumn("earlier", F.slice(keys, F.lit(1), F.col("__at"))).drop(keys, "__at")


def pairs_of(index: DataFrame, changed: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids with a common (kind, key); with ``facts``, a table with ids, both their rows as structs a and b beside a_id and b_id.

    A pair comes out at the first key that both have, so none is met twice and
    only ids with their keys and facts are shuffled, never pairs.
    """
    held = index.dropna(subset=["kind", "key"]).groupBy("id").agg(ordered_keys(F.collect_set(F.struct("kind", "key"))).alias("held"))
    if changed is not None:
        late = changed.select(F.col(changed.columns[0]).alias("id")).distinct().withColumn("late", F.lit(True))
        held = held.join(late, "id", "left")
    if facts is not None:
        held = held.join(facts.select("id", F.struct(*facts.columns).alias("facts")), "id")
    rows = entries(held)
    side = lambda df, n: df.select(*(F.col(c).alias(c if c == "k" else f"{n}_{c}") for c in df.columns))
    left, right = side(rows if changed is None else rows.filter("late"), "x"), side(rows, "y")
    once = F.col("x_id") < F.col("y_id") if changed is None else (F.col("x_id") < F.col("y_id")) | (F.col("x_id") > F.col("y_id")) & F.col("y_late").isNull()
    first = (F.size("x_earlier") == 0) | (F.size("y_earlier") == 0) | ~F.arrays_overlap("x_earlier", "y_earlier")
    met = left.join(right.hint("merge"), (left["k"] == right["k"]) & once & first)
    if facts is None:
        return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    straight = F.col("x_id") < F.col("y_id")
    of = lambda first, c: F.when(straight == first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")) if changed is not None else F.col(f"{'x' if first else 'y'}_{c}")
    return met.select(of(True, "id").alias("a_id"), of(False, "id").alias("b_id"), of(True, "facts").alias("a"), of(False, "facts").alias("b"))


def block_sizes(records: DataFrame, keys: Column) -> DataFrame:
    """Number of records by kind and key, the largest first: what makes pairs many."""
    return records.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "key")


def domain_end(c: Column) -> Column:
    """The last label of a domain, or the last two from three labels on, with a dot before."""
    last = lambda parts: F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.get(parts, F.size(parts) - 1))
    return F.concat(F.lit("."), V.let(F.split(F.regexp_replace(F.lower(c), r"^www\.", ""), r"\."), last))


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES["A"], "A")
    for g in ("B", "C"):
        out = out.when(score >= GRADES[g], g)
    return out.otherwise("D")


def company_facts(r: Column | None = None, host: Column | None = None) -> list[Column]:
    """What score_companies compares, of a record (or of a struct of one): host (unless given), profile, phone, plain name and industry, end of the domain."""
    at = (lambda f: F.col(f)) if r is None else (lambda f: r[f])
    host, phone = extract_domain(at("domain")) if host is None else host, digits(at("phone"))
    low = lambda c: V.trim(F.lower(c))
    return [
        host.alias("host"), linkedin_id(at("linkedin")).alias("profile"), F.when(F.length(phone) >= 7, phone).alias("call"),
        F.when(at("name") != "", low(at("name"))).alias("plain"), low(at("industry")).alias("trade"), domain_end(host).alias("end"),
    ]


def comparable(records: DataFrame, id: str = "id") -> DataFrame:
    """Ids and facts of records: normalized once for each record, not for each pair."""
    return records.select(id, *company_facts())


def score_companies(pairs: DataFrame, penalty: int = 20) -> DataFrame:
    """pairs has structs a and b with the facts of comparable(), or with name, domain, phone, industry, linkedin; adds confidence, grade, name_similarity, signal_count, signals."""
    if "host" not in pairs.schema["a"].dataType.names:
        pairs = pairs.withColumns({side: F.struct(*company_facts(F.col(side))) for side in ("a", "b")})
    same = lambda f: F.coalesce((F.col("a")[f] == F.col("b")[f]) & (F.col("a")[f] != ""), F.lit(False))
    x, y, own = F.col("a")["end"], F.col("b")["end"], list(NATIONAL_ENDS)
    p, q = F.col("a")["plain"], F.col("b")["plain"]  # in lower case already
    sim = F.when(p == q, 1.0).when((p == "") | (q == ""), 0.0).otherwise(1 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q)))
    out = pairs.withColumns({
        "__domain": same("host"), "__profile": same("profile"), "__phone": same("call"), "__industry": same("trade"),
        "__ends": F.coalesce(((x == ".com") & y.isin(own)) | ((y == ".com") & x.isin(own)), F.lit(False)),
        "__sim": F.when(p.isNotNull() & q.isNotNull(), sim),
    })
    alike, m = F.coalesce("__sim", F.lit(0.0)), (lambda f: F.col(f"__{f}"))
    out = out.withColumns({
        "__name": F.when(alike >= 0.85, V.round_half_up(15 + (alike - 0.85) * 66)).otherwise(0.0),
        "__trade": F.when((alike >= 0.7) & m("industry"), 10.0).otherwise(0.0),
    })
    total = F.when(m("domain") | m("profile"), 95.0).otherwise(0.0) + F.when(m("phone"), 20.0).otherwise(0.0) + m("name") + m("trade")
    out = out.withColumn("__total", F.least(F.greatest(total - F.when(m("ends"), float(penalty)).otherwise(0.0), F.lit(0.0)), F.lit(100.0)))
    none = F.array().cast("array<struct<tier:int,type:string,deterministic:boolean,score:double>>")
    signal = lambda when, kind, tier, points, sure: F.when(when, F.array(F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("type"), F.lit(sure).alias("deterministic"), points.cast("double").alias("score")))).otherwise(none)
    signals = F.concat(
        signal(m("domain"), "domain", 1, F.lit(95), True), signal(m("profile"), "linkedin", 1, F.lit(95), True), signal(m("phone"), "phone", 2, F.lit(20), True),
        signal(m("name") > 0, "name", 3, m("name"), False), signal(m("trade") > 0, "name_industry", 4, m("trade"), False), signal(m("ends"), "tld_mismatch", 0, F.lit(-penalty), False),
    )
    count = sum((F.when(x, 1).otherwise(0) for x in (m("profile"), m("phone"), m("name") > 0, m("trade") > 0, m("ends"))), F.when(m("domain"), 1).otherwise(0))
    keep = [c for c in pairs.columns if c not in ("confidence", "grade", "name_similarity", "signal_count", "signals")]
    return out.select(*keep, m("sim").alias("name_similarity"), m("total").alias("confidence"), grade(m("total")).alias("grade"), count.alias("signal_count"), signals.alias("signals"))


#: The most that phone, name and industry give a pair without a common host or profile.
UNSURE = 55


def company_pairs(records: DataFrame, least: float = 0, id: str = "id", excluded: tuple[str, ...] = SHARED_DOMAINS) -> DataFrame:
    """Pairs (a_id, b_id) of companies (name, domain, phone, industry, linkedin) that share a blocking key, scored; with ``least`` those of this confidence or more.

    Facts travel with the keys, so pairs are scored where they meet.  From more
    than UNSURE on host or profile must agree as well, so records meet by these
    only: crowded phone and name keys make no pairs that would be dropped.
    """
    made = records.select(F.col(id).alias("id"), "name", "domain", "phone", "industry", "linkedin").withColumns({"host": extract_domain(F.col("domain")), "profile": linkedin_id(F.col("linkedin"))})
    letters = F.regexp_replace(F.lower(V.text(F.col("name"))), "[^a-z0-9]", "")
    keyed = made.select("id", "host", "profile", digits(F.col("phone")).alias("number"), letters.alias("letters"))
    keyed = keyed.select("id", "host", "profile", keys_of(*(F.col(c) for c in ("host", "profile", "number", "letters")), excluded).alias("keys"))
    if least > UNSURE:
        keyed = keyed.select("id", sure_keys(F.col("keys"), F.col("host"), F.col("profile")).alias("keys"))
    scored = score_companies(pairs_of(index_of(keyed), facts=made.select("id", *company_facts(host=F.col("host")))))
    return scored.filter(F.col("confidence") >= least) if least > 0 else scored


def sure_keys(keys: Column, host: Column, profile: Column) -> Column:
    """Keys that two records share if they share one of company_keys and host or profile.

    A host or profile that is a key itself stands alone; one that is none (a shared domain) goes with each of the keys.
    """
    def of(kind: str, value: Column) -> Column:
        own = F.struct(F.lit(kind).alias("kind"), value.alias("key"))
        each = F.transform(keys, lambda k: F.struct(F.concat(F.lit(f"{kind} and "), k["kind"]).alias("kind"), F.concat(value, F.lit("\0"), k["key"]).alias("key")))
        alone = F.exists(keys, lambda k: (k["kind"] == kind) & (k["key"] == value))
        return F.when(value != "", F.when(alone, F.array(own)).otherwise(each)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))

    return F.concat(of("domain", host), of("linkedin", profile))


def score_contacts(pairs: DataFrame) -> DataFrame:
    """pairs has structs a and b with email, name, company, phone, linkedin; adds confidence and grade."""
    a, b = F.col("a"), F.col("b")
    same = lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False))
    phone = lambda c: F.when(F.length(digits(c)) >= 7, digits(c))
    low = lambda c: V.trim(F.lower(V.text(c)))
    email, profile, call = same(email_lowercase(a["email"]), email_lowercase(b["email"])), same(linkedin_id(a["linkedin"]), linkedin_id(b["linkedin"])), same(phone(a["phone"]), phone(b["phone"]))
    name, firm = similarity(low(a["name"]), low(b["name"])), similarity(low(a["company"]), low(b["company"]))
    both = F.least(name, firm)
    sure = profile.cast("int") + call.cast("int") + (both >= 0.85).cast("int")
    best = F.greatest(F.when(profile, 0.9).otherwise(0.0), F.when(both >= 0.85, 0.85).when(both >= 0.7, (name + firm) / 2 * 0.7).otherwise(0.0), F.when(call, 0.8).otherwise(0.0), F.when((sure == 0) & (name >= 0.85), name * 0.5).otherwise(0.0))
    confidence = F.when(email, 95.0).otherwise(F.least(best * 100, F.lit(100.0)))
    graded = F.when(email | (sure >= 2), "A").when(sure == 1, "B").when(name >= 0.85, "C").otherwise("D")
    return pairs.withColumns({"confidence": confidence, "grade": graded, "name_similarity": name})


def comparison_form(c: Column, field: str) -> Column:
    """A field's value as the normalized comparison has it: + and digits of phones, host of addresses, else small letters and single blanks."""
    if "phone" in field:
        d = digits(c)
        return F.concat(F.when(F.length(d) == 10, "+1").otherwise("+"), d)
    if field == "domain" or "url" in field or "website" in field:
        return F.substring_index(F.regexp_replace(F.lower(c), r"^(https?://)?(www\.)?", ""), "/", 1)
    return F.regexp_replace(V.trim(F.lower(c)), r"\s+", " ")


def score_by_groups(pairs: DataFrame, groups: list[dict]) -> DataFrame:
    """Signal groups: all conditions of a group must hold, on filled values, and the first such group wins.

    A condition has field, match_type (exact: without case and blanks,
    normalized: by the kind of field, fuzzy: Jaro-Winkler from the threshold
    on), weight and threshold.  As every condition of the group holds, its
    score is all of its weight, 100, and 0 if the weights are; grades from 97, 85 and 70.
    """
    plain = lambda v: F.regexp_replace(V.trim(F.lower(v)), r"\s+", " ")

    def holds(c: dict) -> Column:
        x, y = F.col("a")[c["field"]].cast("string"), F.col("b")[c["field"]].cast("string")
        test = {
            "exact": lambda: plain(x) == plain(y), "normalized": lambda: comparison_form(x, c["field"]) == comparison_form(y, c["field"]),
            "fuzzy": lambda: jaro_winkler(plain(x), plain(y)) >= c["threshold"],
        }[c["match_type"]]()
        return F.coalesce((x != "") & (y != "") & test, F.lit(False))

    found = F.lit(None).cast("struct<group:string,confidence:double,signals:array<string>>")
    for g in reversed(groups):
        every = F.lit(True)
        for c in g["conditions"]:
            every &= holds(c)
        whole = 100.0 if sum(c["weight"] for c in g["conditions"]) > 0 else 0.0
        hit = F.struct(F.lit(g["id"]).alias("group"), F.lit(whole).alias("confidence"), F.array(*(F.lit(c["field"]) for c in g["conditions"])).alias("signals"))
        found = F.when(every, hit).otherwise(found)
    score = F.coalesce(found["confidence"], F.lit(0.0))
    return pairs.withColumns({"group": found["group"], "confidence": score, "grade": F.when(score >= 97, "A").when(score >= 85, "B").when(score >= 70, "C").otherwise("D"), "signals": found["signals"]})


# Weights of a composite similarity.
COMPOSITE = {"domain": 0.5, "name": 0.25, "phone": 0.1, "industry": 0.08, "employees": 0.07}


def composite_similarity(a: Column, b: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted similarity of two records: equal domains, edit similarity of name, phone and industry, size bands (a neighbouring one counts half)."""
    w = weights or COMPOSITE
    filled = lambda x, y, value: F.coalesce(F.when((x != "") & (y != ""), value), F.lit(0.0))
    alike = lambda x, y: filled(x, y, similarity(x, y))
    tops = [top for top, _ in EMPLOYEE_BANDS]
    band = lambda n: F.when(n > 0, reduce(lambda x, y: x + y, ((n > top).cast("int") for top in tops)))
    hosts = extract_domain(a["domain"]), extract_domain(b["domain"])
    steps = F.abs(band(V.leading_number(a["employees"])) - band(V.leading_number(b["employees"])))
    parts = {
        "domain": filled(*hosts, F.when(hosts[0] == hosts[1], 1.0).otherwise(0.0)), "name": alike(V.text(a["name"]), V.text(b["name"])),
        "phone": alike(digits(V.text(a["phone"])), digits(V.text(b["phone"]))), "industry": alike(F.lower(V.text(a["industry"])), F.lower(V.text(b["industry"]))),
        "employees": F.coalesce(F.when(steps == 0, 1.0).when(steps == 1, 0.5), F.lit(0.0)),
    }
    total = sum(w.values())
    return reduce(lambda x, y: x + y, (parts[k] * (v / total) for k, v in w.items())) if total else F.lit(0.0)


def tld_penalty(a: Column, b: Column, flagged: list[tuple[str, str]], penalty: float = 20.0) -> Column:
    """What a configured rule takes off the confidence of two domains whose ends are one of the flagged pairs, in any order."""
    x, y = domain_end(a), domain_end(b)
    hit = reduce(lambda p, q: p | q, (((x == u) & (y == v)) | ((x == v) & (y == u)) for u, v in flagged), F.lit(False))
    return F.when(F.coalesce(hit, F.lit(False)), float(penalty)).otherwise(0.0)


def with_records(pairs: DataFrame, records: DataFrame, id: str = "id") -> DataFrame:
    """Pairs of ids (a, b) with both records as structs; ids stay as a_id and b_id."""
    side = lambda name: records.select(F.col(id).alias(f"{name}_id"), F.struct(*[c for c in records.columns]).alias(name))
    return pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id")).join(side("a"), "a_id").join(side("b"), "b_id")


def clusters(pairs: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Components of two or more: cluster, record_ids, pairs (number) and grade, the best of its pairs'."""
    scratch = Scratch(pairs.sparkSession, "clusters")
    scored = scratch.write(pairs.select(F.col(a).alias("u"), F.col(b).alias("v"), "grade"), "pairs")
    roots = connected_components(scored.select("u", "v"), scratch)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = roots.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("record_ids"))
    facts = scored.join(roots, scored["u"] == roots["node"]).groupBy("root").agg(F.count("*").alias("pairs"), F.min("grade").alias("grade"))
    return members.join(facts, "root").select(F.col("root").alias("cluster"), "record_ids", "pairs", "grade")


def members(clustered: DataFrame) -> DataFrame:
    return clustered.select("cluster", F.explode("record_ids").alias("id"))


def auto_merge(clustered: DataFrame, pairs: DataFrame, threshold: float, a: str = "a_id", new: DataFrame | None = None, now: Column | None = None, hours: int = 24) -> DataFrame:
    """Clusters of grade A with a pair at or above threshold x 100; with ``new``, a table of cluster ids, these only, with ``status`` only pending ones, with ``now`` when each is due."""
    strong = pairs.filter(F.col("confidence") >= threshold * 100).select(F.col(a).alias("id"))
    able = clustered.filter("grade = 'A'")
    if "status" in clustered.columns:
        able = able.filter("status = 'pending'")
    if new is not None:
        able = able.join(new.select(F.col(new.columns[0]).alias("cluster")).distinct(), "cluster", "left_semi")
    touched = members(able).join(strong, "id", "left_semi").select("cluster").distinct()
    out = able.join(touched, "cluster", "left_semi")
    return out if now is None else out.withColumn("scheduled_at", now + F.make_interval(hours=F.lit(hours)))


def without_excluded(records: DataFrame, keys: Column, excluded: DataFrame, id: str = "id") -> DataFrame:
    """(id, kind, key) of all blocking keys but domains of a table (domain): an organisation's exclusions beside the built-in ones.  The table is normalized as domains of records are."""
    gone = excluded.select(F.lit("domain").alias("kind"), extract_domain(F.col(excluded.columns[0])).alias("key")).distinct()
    return index_of(records.select(F.col(id).alias("id"), keys.alias("keys"))).dropna().join(gone, ["kind", "key"], "left_anti").select("id", "kind", "key")


def stale_clusters(clustered: DataFrame, changed: DataFrame) -> DataFrame:
    """Clusters that hold a changed id."""
    touched = members(clustered).join(changed.select(F.col(changed.columns[0]).alias("id")), "id", "left_semi").select("cluster").distinct()
    return clustered.join(touched, "cluster", "left_semi")


def suppressed(pairs: DataFrame, listed: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Pairs without those of an unordered list."""
    x, y = listed.columns[:2]
    gone = listed.select(F.least(x, y).alias("__x"), F.greatest(x, y).alias("__y")).distinct()
    return pairs.join(gone, (F.least(a, b) == F.col("__x")) & (F.greatest(a, b) == F.col("__y")), "left_anti")
