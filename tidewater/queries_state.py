"""Registered queries of files, caches, registries, persons, prospects and event state, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import names, text
from tidewater.operators import dedup, lookup, matching, resolve, scoring, survivorship
from tidewater.plans import predicates, rules
from tidewater.queries import CHANGES, SPECS, companies, on_cands, oracle, query, table
from tidewater.sources import tables
from tidewater.storage import shared_folder
from tidewater.streaming import events

K = "substr({0}, 2)::BIGINT"


def _key(c: str = "id"):
    return F.substring(c, 2, 9).cast("bigint")


# Files and caches

@query(oracle("SELECT id, CASE WHEN contacts = 0 THEN '''=' || name WHEN contacts = 1 THEN 'say \"' || name || '\", ok' ELSE name END AS company_name, nullif(coalesce(email, ''), '') AS e_mail FROM companies"))
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted CSV with cells that no spreadsheet runs, written to the shared folder and read with a normalized header."""
    path = f"{shared_folder(spark)}/tidewater/csv-{uuid.uuid4().hex}"
    name = F.when(F.col("contacts") == 0, F.concat(F.lit("="), "name")).when(F.col("contacts") == 1, F.concat(F.lit('say "'), "name", F.lit('", ok'))).otherwise(F.col("name"))
    tables.write_csv(companies(spark, sf_dir).select("id", name.alias("Company Name"), F.col("email").alias("E-Mail")), path)
    return tables.read_csv(spark, path)


@query(oracle("SELECT id, CASE WHEN contacts = 3 THEN NULL ELSE employees_ END AS employees, contacts = 3 AS rejected, CASE WHEN contacts = 3 THEN id || ',x,y,z' END AS line FROM (SELECT id, contacts, nullif(deals::VARCHAR, '') AS employees_ FROM companies)"))
def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of another width are kept apart and can be counted."""
    path = f"{shared_folder(spark)}/tidewater/csv-{uuid.uuid4().hex}"
    c = companies(spark, sf_dir)
    c.select(F.when(F.col("contacts") == 3, F.concat("id", F.lit(",x,y,z"))).otherwise(F.concat("id", F.lit(',"'), F.col("deals").cast("string"), F.lit('"')))).write.text(path)
    rows, rejected = tables.read_csv_checked(spark, path, ["id", "employees"], header=False)
    none = F.lit(None).cast("string")
    return rows.select("id", "employees", F.lit(False).alias("rejected"), none.alias("line")).unionByName(rejected.select(F.col("first").alias("id"), none.alias("employees"), F.lit(True).alias("rejected"), "line"))


@query(oracle("SELECT * FROM (SELECT unnest(['c1', 'c2', 'c3', 'Email', 'c5']) AS column, unnest([CASE WHEN avg((email LIKE '%_@_%._%')::INT) > 0.8 THEN 'email' ELSE 'text' END, 'linkedin', CASE WHEN avg(regexp_matches(phone, '^[+(]?[0-9][0-9 ().-]{6,}$')::INT) > 0.8 THEN 'phone' ELSE 'text' END, 'email', 'text']) AS kind FROM (SELECT nullif(email, '') AS email, phone FROM companies))"))
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of an import hold, by their headers and their values."""
    c = companies(spark, sf_dir).select(F.expr("nullif(email, '')").alias("c1"), F.expr("nullif(linkedin, '')").alias("c2"), F.col("phone").alias("c3"), F.col("state").alias("Email"), F.col("industry").alias("c5"))
    return spark.createDataFrame(list(tables.column_kinds(c).items()), "column string, kind string")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have not expired."""
    return tables.live(table(spark, sf_dir, "events").withColumnRenamed("ts", "ttl_expires_at"), F.lit("2024-01-10").cast("timestamp")).select("event_id")


CACHED = "(SELECT l_partkey AS record_id, 'p' || (l_suppkey % 5)::VARCHAR AS provider, l_shipdate AS e, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_suppkey::VARCHAR END AS name, l_returnflag AS flag FROM lineitem)"
RANK = "coalesce(nullif(list_position(['p2', 'p0'], provider), 0), 3)"


@query(f"SELECT record_id, min_by(name, ({RANK}, provider, name)) FILTER (name IS NOT NULL) AS name, min_by(flag, ({RANK}, provider, flag)) AS flag FROM (SELECT DISTINCT record_id, provider, first_name AS name, first_flag AS flag FROM (SELECT record_id, provider, min(name) OVER w AS first_name, min(flag) OVER w AS first_flag FROM {CACHED} WHERE e > TIMESTAMP '1995-01-01' WINDOW w AS (PARTITION BY record_id, provider))) GROUP BY record_id")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of a cache, melted, resolved by provider and pivoted to one row a record."""
    x = table(spark, sf_dir, "lineitem")
    rows = x.select(F.col("l_partkey").alias("record_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("provider"), F.col("l_shipdate").alias("ttl_expires_at"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("name"), F.col("l_returnflag").alias("flag"))
    once = rows.groupBy("record_id", "provider").agg(*(F.min(F.when(F.col("ttl_expires_at") > "1995-01-01", F.col(c))).alias(c) for c in ("name", "flag")), F.max("ttl_expires_at").alias("ttl_expires_at"))
    ranked = once.withColumn("provider", F.concat(F.when(F.col("provider") == "p2", "1").when(F.col("provider") == "p0", "2").otherwise("3"), "provider"))
    return resolve.cached_rows(ranked, ["name", "flag"], ["1p2", "2p0", "3p1", "3p3", "3p4"], F.lit("1995-01-01").cast("timestamp"))


@query(f"SELECT record_id AS domain, arg_min(name, ({RANK}, provider)) FILTER (name IS NOT NULL) AS name, array_to_string(list_sort(list(DISTINCT flag)), ',') AS technologies, (SELECT string_agg(p, '+' ORDER BY r, p) FROM (SELECT DISTINCT provider AS p, {RANK} AS r FROM {CACHED} b WHERE b.record_id = a.record_id)) AS provider FROM (SELECT record_id, provider, min(name) AS name, min(flag) AS flag FROM {CACHED} GROUP BY record_id, provider) a GROUP BY record_id")
def prospect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a company from several providers, the most trusted first."""
    x = table(spark, sf_dir, "lineitem")
    rows = x.groupBy(F.col("l_partkey").alias("domain"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("provider")).agg(F.min(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("n"), F.col("l_suppkey").cast("string")))).alias("name"), F.array(F.min("l_returnflag")).alias("technologies"))
    return resolve.merge_prospects(rows, ["p2", "p0"], ["name"]).withColumn("technologies", F.array_join("technologies", ","))


# Lookups and registries

@query(oracle("SELECT t AS token, CASE WHEN t = 'BUILDING' THEN 'Build!' WHEN t = 'MACHINERY' THEN 'Machines' END AS canonical_form, CASE WHEN t = 'BUILDING' THEN 'org' WHEN t = 'MACHINERY' THEN 'global' END AS scope FROM (SELECT DISTINCT industry AS t FROM companies)"))
def registry_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An organisation's entries before the common ones, retired ones never."""
    registry = spark.createDataFrame([("BUILDING", "Build", None, "active"), ("BUILDING", "Build!", "o1", "active"), ("MACHINERY", "Machines", None, "active"), ("MACHINERY", "M", "o2", "active"), ("FURNITURE", "F", None, "retired")], "input_token string, canonical_form string, org_id string, status string")
    return lookup.registry_lookup(companies(spark, sf_dir).select("industry"), registry, "o1")


@query(oracle("SELECT DISTINCT v AS value, CASE WHEN k = 0 THEN 'Construction' WHEN k = 1 THEN 'Industrial' WHEN k = 2 THEN 'Construction' END AS canonical, CASE WHEN k = 0 THEN 'exact' WHEN k < 3 THEN 'part_exact' ELSE 'none' END AS match_type, CASE WHEN k < 3 THEN 100 ELSE 0 END AS confidence FROM (SELECT CASE contacts % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'x, machinery / ' || industry WHEN 2 THEN industry || 'X & building' ELSE 'none;' || industry || 'Z' END AS v, contacts % 4 AS k FROM companies)"))
def compound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value as a whole, else its first part that the list knows."""
    k = F.col("contacts") % 4
    v = F.when(k == 0, "building").when(k == 1, F.concat(F.lit("x, machinery / "), "industry")).when(k == 2, F.concat("industry", F.lit("X & building"))).otherwise(F.concat(F.lit("none;"), "industry", F.lit("Z")))
    reference = spark.createDataFrame([("building", "Construction", None, True, False), ("machinery", "Industrial", None, True, False)], "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    return lookup.classify_compound(companies(spark, sf_dir).select(v.alias("v")), reference)


# Pairs and survivors

MAIL = "trim(lower(coalesce(email, '')))"
DIG = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"


@query(oracle(f"""WITH_KEYS SELECT DISTINCT x.id AS a, y.id AS b FROM ck x JOIN ck y ON x.kind = y.kind AND x.key = y.key AND x.id < y.id""".replace("WITH_KEYS ", ""), f"ck AS (SELECT id, 'email' AS kind, {MAIL} AS key FROM companies WHERE {MAIL} <> '' AND contacts < 3 UNION SELECT id, 'phone', left({DIG}, 6) FROM companies WHERE length({DIG}) >= 7 UNION SELECT id, 'linkedin', 'acme-' || grp FROM companies WHERE linkedin <> '')").replace("AND contacts < 3 ", "AND email LIKE '%@%'"))
def contact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of persons by mail, phone and profile (an address without @ is none here)."""
    c = companies(spark, sf_dir).withColumn("email", F.when(F.col("email").contains("@"), F.col("email")))
    return dedup.candidate_pairs(c, dedup.contact_keys(F.col("email"), F.col("phone"), F.col("linkedin")))


@query(oracle("SELECT x.id AS a, y.id AS b, lower(coalesce(x.phone, '')) <> lower(coalesce(y.phone, '')) AS differs, lower(x.industry) = lower(y.industry) AS matches, trim(lower(coalesce(x.email, ''))) = '' AND trim(lower(coalesce(y.email, ''))) = '' AS both_blank, lower(x.name) LIKE '%inc%' OR lower(y.name) LIKE '%inc%' AS either_has FROM companies x JOIN companies y ON x.grp = y.grp AND x.id < y.id"))
def suppression_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions between the two records of a pair."""
    c = companies(spark, sf_dir)
    side = lambda n: c.select("grp", F.col("id").alias(f"{n}_id"), F.struct(*c.columns).alias(n))
    s = predicates.suppression
    return side("a").join(side("b"), "grp").filter("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), s("phone", "differs_between").alias("differs"), s("industry", "matches_between").alias("matches"), s("email", "is_blank", scope="both").alias("both_blank"), s("name", "contains", "INC", "either").alias("either_has"))


PARTNERS = f"pp AS (SELECT m.id, m.contacts AS mc, d.contacts AS dc, m.industry AS mi, d.industry AS di FROM companies m JOIN companies d ON m.grp = d.grp AND {K.format('m.id')} % 3 = 0 AND {K.format('d.id')} % 3 = 1)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = companies(spark, sf_dir)
    side = lambda r, n: c.filter(_key() % 3 == r).select("grp", F.struct(*c.columns).alias(n))
    return side(0, "a").join(side(1, "b"), "grp")


@query(oracle("SELECT id, CASE WHEN (mi = 'BUILDING') <> (di = 'BUILDING') THEN CASE WHEN mi = 'BUILDING' THEN 'a' ELSE 'b' END WHEN (mc >= 3) <> (dc >= 3) THEN CASE WHEN mc >= 3 THEN 'a' ELSE 'b' END END AS winner FROM pp", PARTNERS))
def group_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group of conditions that holds for one side only."""
    groups = [{"priority": 2, "conditions": [{"field": "contacts", "operator": "gte", "value": 3}]}, {"priority": 1, "conditions": [{"field": "industry", "operator": "eq", "value": "Building"}]}]
    return _sides(spark, sf_dir).select(F.col("a.id").alias("id"), survivorship.group_winner(groups).alias("winner"))


@query(oracle("SELECT id, CASE WHEN mc >= 3 THEN 'ann' WHEN dc >= 3 THEN 'bob' WHEN mc = 0 THEN NULL ELSE 'ann' END AS owner, CASE WHEN mc >= 3 THEN 'kept_active' WHEN dc >= 3 THEN 'fallback' WHEN mc = 0 THEN 'unassigned' ELSE 'kept_inactive' END AS how FROM pp", PARTNERS))
def merge_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner after a merge."""
    a, b = F.col("a.contacts"), F.col("b.contacts")
    made = survivorship.owner(F.when(a != 0, "ann"), F.when(b >= 3, "bob"), a >= 3, b >= 3, None)
    return _sides(spark, sf_dir).select(F.col("a.id").alias("id"), made.alias("o")).select("id", "o.*")


# Functions

@query(oracle("SELECT id, CASE k WHEN 0 THEN '2023-06-05T14:07:09.000Z' WHEN 1 THEN '2023-06-05T00:00:00.000Z' WHEN 2 THEN '2023-06-05T00:00:00.000Z' WHEN 3 THEN '2023-06-05T00:00:00.000Z' END AS iso, CASE WHEN k < 4 THEN '2023-06-05' END AS day, CASE WHEN k < 4 THEN CASE k WHEN 0 THEN 1685974029000 ELSE 1685923200000 END END AS ms FROM (SELECT id, contacts AS k FROM companies)"))
def functions_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """absolute dates in several forms."""
    d = F.get(F.array(*map(F.lit, ("2023-06-05 14:07:09", "June 5, 2023", "6/5/2023", "5 Jun 2023", "someday"))), F.col("contacts"))
    return companies(spark, sf_dir).select("id", text.parse_date(d).alias("iso"), text.parse_date(d, "date").alias("day"), text.parse_date(d, "timestamp").alias("ms"))


@query(oracle(f"""SELECT id, regexp_matches(coalesce(phone, ''), '([0-9]{{3}})-([0-9]{{4}})$') AND phone IS NOT NULL AS matched, CASE WHEN regexp_matches(coalesce(phone, ''), '([0-9]{{3}})-([0-9]{{4}})$') THEN regexp_extract(phone, '([0-9]{{3}})-([0-9]{{4}})$', 2) END AS last4,
  CASE WHEN domain LIKE 'https%' THEN 'https://' || lower(regexp_extract(domain, '://([^/]+)', 1)) || '/about' WHEN domain IS NOT NULL THEN 'https://' || lower(domain) || '/' END AS url, lower(trim(name)) || '|' AS low FROM companies"""))
def functions_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups of a pattern, canonical addresses, the first filled value."""
    m = text.match_pattern(F.col("phone"), r"([0-9]{3})-([0-9]{4})$", 2)
    url = F.when(F.col("domain").isNotNull(), text.url_canonical(F.col("domain")))
    return companies(spark, sf_dir).select("id", m["matched"].alias("matched"), F.get(m["groups"], F.lit(1)).alias("last4"), url.alias("url"), F.concat(text.first_filled(F.lit(" "), F.lower(F.trim("name"))), F.lit("|")).alias("low"))


PEOPLE = ("Jane Doe, MBA", "Sam  Lee PhD", "Ann van Dyk", "Solo", "Kim Roe - CPA®")


@query(oracle("SELECT id, ['Jane', 'Sam', 'Ann', 'Solo', 'Kim'][contacts + 1] AS first, ['Doe', 'Lee', 'van Dyk', '', 'Roe -'][contacts + 1] AS last, h AS hash, CASE contacts WHEN 0 THEN 'same' WHEN 1 THEN name ELSE 'x' END AS written, CASE WHEN contacts = 0 THEN '$0' WHEN contacts < 3 THEN '$' || printf('%.1f', contacts * 1234567.0 / 1e6) || 'M' ELSE '$' || printf('%.1f', contacts * 1234567.0 / 1e6) || 'M' END AS revenue FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(industry, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM companies)"))
def functions_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts of a name, what a write policy leaves, a hash for dealing out, money for display."""
    full = F.get(F.array(*map(F.lit, PEOPLE)), F.col("contacts"))
    n = names.split_full_name(full)
    written = names.write_policy(F.when(F.col("contacts") == 0, "never").when(F.col("contacts") == 1, "always").otherwise("if_blank"), F.when(F.col("contacts") == 0, "same").when(F.col("contacts") == 1, "old").otherwise(" "), F.when(F.col("contacts") == 1, F.col("name")).otherwise("x"))
    return companies(spark, sf_dir).select("id", n["first"].alias("first"), n["last"].alias("last"), names.string_hash(F.col("industry")).alias("hash"), written.alias("written"), names.revenue_display(F.col("contacts") * 1234567.0).alias("revenue"))


PROFILE = {"industries": ["house", "Building", "household"], "employee_min": 300, "employee_max": 900, "states": ["ca"], "countries": ["US"], "technologies": ["aws", "gcp", "sql"]}


@query(oracle("""SELECT id, floor(i + s + l + t + 0.5)::INT AS score, floor(i + 0.5)::INT AS industry, floor(s + 0.5)::INT AS size, floor(l + 0.5)::INT AS location, floor(t + 0.5)::INT AS technology FROM (
  SELECT id, CASE WHEN industry = 'BUILDING' THEN 35 WHEN industry = 'HOUSEHOLD' THEN 21 ELSE 0 END::DOUBLE AS i, CASE contacts WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 25 WHEN 3 THEN 25 * (1 - 300 / 900.0::DOUBLE) ELSE 25 * (1 - 700 / 900.0::DOUBLE) END::DOUBLE AS s,
    CASE contacts WHEN 0 THEN 16 WHEN 1 THEN 12 ELSE 0 END::DOUBLE AS l, CASE deals WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END::DOUBLE AS t FROM companies)"""))
def fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how well a company fits a profile, in all and by part."""
    tech = F.when(F.col("deals") == 0, F.array(F.lit("AWS Lambda"), F.lit("PostgreSQL"))).when(F.col("deals") == 1, F.array(F.lit("Gcp"), F.lit("x")))
    fit = scoring.profile_score(PROFILE, F.col("industry"), F.col("contacts") * 400, F.lit("Oslo"), F.when(F.col("contacts") == 0, "CA").otherwise("zz"), F.when(F.col("contacts") == 1, "us").otherwise("xx"), tech)
    return companies(spark, sf_dir).select("id", fit.alias("fit")).select("id", "fit.*")


DECIDED = """p AS (SELECT a.id AS pair_id, a.grp % 10 < 8 AS longer_won, a.name AS an, b.name AS bn, a.domain AS ad, b.domain AS bd, a.created AS ac, b.created AS bc,
    list_sum(list_transform([a.id, a.name, a.domain, a.phone, a.linkedin, a.created], lambda x: coalesce(x <> '', false)::INT)) AS af, list_sum(list_transform([b.id, b.name, b.domain, b.phone, b.linkedin, b.created], lambda x: coalesce(x <> '', false)::INT)) AS bf
  FROM companies a JOIN companies b ON a.grp = b.grp AND substr(a.id, 2)::BIGINT % 3 = 0 AND substr(b.id, 2)::BIGINT % 3 = 1 WHERE a.grp % 9 <> 0 AND a.grp % 12 <> 0),
v AS (SELECT 'name' AS field, 'prefer_longest' AS strategy, CASE WHEN length(an) <> length(bn) THEN NOT longer_won = (length(an) > length(bn)) END AS vote FROM p
  UNION ALL SELECT 'domain', 'tld_preference', CASE WHEN (string_split(ad, '.')[-1] = 'com') <> (string_split(bd, '.')[-1] = 'com') THEN NOT longer_won = (string_split(ad, '.')[-1] = 'com') END FROM p
  UNION ALL SELECT 'createdate', 'prefer_newest', CASE WHEN ac <> bc THEN NOT longer_won = (ac > bc) END FROM p
  UNION ALL SELECT '*', 'prefer_nonempty', CASE WHEN af <> bf THEN NOT longer_won = (af > bf) END FROM p)"""


@query(oracle("SELECT field, strategy, floor(avg(vote::INT) * 100 + 0.5)::INT AS confidence, count(*) AS sample_count FROM v WHERE vote IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND avg(vote::INT) >= 0.7", DECIDED))
def calibration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four signals of calibration decisions, and the rules that they suggest."""
    c, k = companies(spark, sf_dir), F.substring("id", 2, 9).cast("bigint") % 3
    side = lambda n, of: c.filter(k == of).select("grp", F.struct("id", "name", "domain", "phone", "linkedin", "created").alias(n))
    samples = side("a", 0).join(side("b", 1), "grp").withColumn("pair_id", F.col("a.id"))
    said = F.when(F.col("grp") % 9 == 0, "unsure").otherwise("duplicate").alias("verdict")
    kept = F.when(F.col("grp") % 12 == 0, "auto").when(F.col("grp") % 10 < 8, "b").otherwise("a").alias("survivor_preference")
    return scoring.suggested_rules(samples.select("pair_id", said, kept), samples)


@query("SELECT l_suppkey % 40 AS signal, count(*) AS n, round(avg((l_linenumber <= 5)::INT), 9) AS ratio, avg((l_linenumber <= 5)::INT) >= 0.7 AS prefers FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND (avg((l_linenumber <= 5)::INT) >= 0.7 OR avg((l_linenumber <= 5)::INT) <= 1 - 0.7::DOUBLE)")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences that decisions agree on."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("signal"), (F.col("l_linenumber") <= 5).alias("longer"))
    return scoring.consistency(d, "signal", "longer").withColumn("ratio", F.round("ratio", 9))


# Rules

@query(oracle("SELECT id, CASE WHEN contacts = 0 AND state IS NOT NULL THEN CASE trim(lower(state)) WHEN 'california' THEN 'CA' WHEN 'tx' THEN 'TX' WHEN 'ohio' THEN 'OH' WHEN 'fla.' THEN 'FL' ELSE state END ELSE state END AS state FROM companies"))
def rule_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification touches records of its sources only."""
    spec = rules.checked({"id": "state", "version": "1.0.0", "field": "state", "sources": ["crm"], "rules": [{"id": "abbreviate", "when": "$value IS NOT NULL", "format": "state_abbreviate"}]})
    c = companies(spark, sf_dir).withColumn("source", F.when(F.col("contacts") == 0, "crm").otherwise("form"))
    return c.select("id", rules.cascade(spec)[0].alias("state"))


@query(oracle("SELECT k.id, coalesce(n.after, k.name) AS name, coalesce(s.after, k.state) AS state, coalesce(e.after, k.employees) AS employees FROM companies k LEFT JOIN changes n ON n.id = k.id AND n.field = 'name' LEFT JOIN changes s ON s.id = k.id AND s.field = 'state' LEFT JOIN changes e ON e.id = k.id AND e.field = 'employees'", CHANGES))
def rule_apply_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after all specifications."""
    return rules.apply_all(companies(spark, sf_dir), SPECS).select("id", "name", "state", "employees")


@query(oracle("SELECT * FROM changes WHERE before <> after ORDER BY id, field LIMIT 50", CHANGES))
def rule_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty changes, before anything is applied."""
    return rules.preview(companies(spark, sf_dir), SPECS)


# Events

@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'deletion' WHEN 'signup' THEN 'merge' WHEN 'click' THEN 'change' ELSE 'creation' END AS handler, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id WHERE ts >= ts - INTERVAL 1 MINUTE AND event_id % 3 <> 0")
def events_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events out, the handler of each, and what is known of its record."""
    e = table(spark, sf_dir, "events")
    received = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 6 MINUTES")).otherwise(F.col("ts") + F.expr("INTERVAL 4 MINUTES"))
    kind = F.when(F.col("event_type") == "purchase", "company.deletion").when(F.col("event_type") == "signup", "company.merge").when(F.col("event_type") == "click", "company.propertyChange").otherwise("company.creation")
    routed = events.routed(events.fresh(e, received).withColumn("subscription", kind), "subscription")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return events.with_records(routed, known, "user_id").select("event_id", "handler", "c_mktsegment")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def events_since_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows behind the high-water mark."""
    import datetime as dt

    return events.changed_since(table(spark, sf_dir, "events"), "ts", dt.datetime(2024, 1, 15))[0].select("event_id")


SESSION = "SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS AS gap FROM events"


@query(f"SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ({SESSION})) GROUP BY user_id, s")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, with a gap of two hours; the same transformation runs on a stream."""
    return events.sessions(table(spark, sf_dir, "events"), "user_id", gap="2 hours")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the stored events, each event twice, drained into batches of upserts and read back.

    Hourly counts come once the watermark has passed; here the stream keeps
    each event once and the last generation of every hour is what counts.
    """
    root = f"{shared_folder(spark)}/tidewater/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    e.unionByName(e).write.parquet(f"{root}/in")
    stream = events.once(events.source(spark, f"{root}/in", e.schema, files=1000), ["event_id"], late="400 days")
    events.drain(stream, events.upsert_sink(f"{root}/out", ["event_id"], "ts"), f"{root}/state")
    kept = spark.read.parquet(f"{root}/out").drop("batch")
    return events.windowed(kept).withColumn("total", F.round("total", 4))


# Persons

LAST = ("Smith, MBA", "Jones PhD", "O'Neil RN MSN", "van Dyke®", "Li - PMP CFA", "Brown", "  Gray  ", "")
CLEAN = ("Smith", "Jones", "O'Neil MSN", "van Dyke", "Li", "Brown", "Gray", "")


@query("SELECT c_custkey, list_extract([" + ", ".join("'" + x.replace("'", "''") + "'" for x in CLEAN) + f"], (c_custkey % {len(LAST)})::INT + 1) AS last FROM customer")
def functions_last_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """last names without credentials."""
    last = F.get(F.array(*map(F.lit, LAST)), (F.col("c_custkey") % len(LAST)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.clean_last_name(last).alias("last"))


@query(oracle("""SELECT DISTINCT id, unnest([lower(trim(name)), b, p, array_to_string(list_transform(w, lambda x: x[1]), '')] || list_filter(w, lambda x: length(x) > 3)) AS token
  FROM (SELECT *, string_split(p, ' ') AS w FROM (SELECT *, regexp_replace(b, '[^a-z0-9 ]', '', 'g') AS p FROM (SELECT id, name, trim(regexp_replace(regexp_replace(lower(trim(name)), ' inc\\.$', ''), ' +', ' ', 'g')) AS b FROM companies)))"""))
def functions_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lookup tokens of company names, one row each."""
    return companies(spark, sf_dir).select("id", F.explode(names.name_tokens(F.col("name"))).alias("token"))


CONTACT = """(SELECT x.grp, x.id AS a, y.id AS b, x.grp // 3 % 5 AS p FROM companies x JOIN companies y ON x.grp = y.grp AND substr(x.id, 2)::BIGINT % 3 = 0 AND substr(y.id, 2)::BIGINT % 3 = 1)"""


@query(oracle(f"SELECT a, b, CASE p WHEN 0 THEN 95.0 WHEN 1 THEN 90.0 WHEN 2 THEN 80.0 WHEN 3 THEN 50.0 ELSE 85.0 END::DOUBLE AS confidence, CASE p WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'B' END AS grade FROM {CONTACT}"))
def contact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: pairs of persons with the same mail address; profile and phone; phone; name alone; name and company."""
    c = companies(spark, sf_dir).withColumn("p", F.expr("grp div 3 % 5")).withColumn("k", F.substring("id", 2, 9).cast("bigint") % 3)
    of = lambda p, value, other=None: F.when(F.col("p").isin(p), value).otherwise(other)
    own = F.concat(F.lit("only"), "id")
    persons = c.select(
        "grp", "k", "id", of([0], F.when(F.col("k") == 0, F.concat(F.lit("P"), "grp", F.lit("@x.com"))).otherwise(F.concat(F.lit("p"), "grp", F.lit("@X.com "))), F.concat(own, F.lit("@x.com"))).alias("email"),
        of([3, 4], F.concat(F.lit("Jo Do "), "grp"), F.when(F.col("k") == 0, "Ann").otherwise("Bartholomew")).alias("name"), of([4], F.lit("Acme"), F.when(F.col("k") == 0, "Wide").otherwise("Monolith")).alias("company"),
        of([1, 2], F.concat(F.lit("310 387 "), F.lpad((F.col("grp") % 10000).cast("string"), 4, "0"))).alias("phone"), of([1], F.concat(F.lit("linkedin.com/in/p"), "grp")).alias("linkedin"))
    side = lambda n, k: persons.filter(F.col("k") == k).select("grp", F.col("id").alias(f"{n}_id"), F.struct("email", "name", "company", "phone", "linkedin").alias(n))
    scored = dedup.score_contacts(side("a", 0).join(side("b", 1), "grp"))
    return scored.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("confidence", 6).alias("confidence"), "grade")


WRITTEN = "CASE substr(id, 2)::BIGINT % 3 WHEN 0 THEN code || ' works' WHEN 1 THEN code || ' zq' ELSE code || 'qqqqqqqqqqqqqqqq' END"
JW = "(jaro_similarity(x, y) + (CASE WHEN x[1:4] = y[1:4] THEN 4 WHEN x[1:3] = y[1:3] THEN 3 ELSE 0 END) * 0.1 * (1 - jaro_similarity(x, y)))"


@query(oracle(f"""SELECT id AS row_id, target AS id, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'match' WHEN score >= 0.75 THEN 'review' ELSE 'none' END AS action FROM (
  SELECT r.id, t.id AS target, CASE WHEN x = y THEN 1.0 ELSE {JW} END AS score FROM (SELECT id, code, {WRITTEN} AS x FROM coded) r JOIN (SELECT id, code || ' works' AS y FROM coded WHERE substr(id, 2)::BIGINT % 3 = 0) t ON x[1:3] = y[1:3]
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY score DESC, t.id) = 1)""", "coded AS (SELECT id, translate(lpad((grp // 3 % 10000)::VARCHAR, 4, '0'), '0123456789', 'abcdefghij') AS code FROM companies)"))
def company_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's best company by name, to match, to review, or none."""
    code = F.translate(F.lpad(F.expr("grp div 3 % 10000").cast("string"), 4, "0"), "0123456789", "abcdefghij")
    c = companies(spark, sf_dir).withColumn("code", code).withColumn("k", F.substring("id", 2, 9).cast("bigint") % 3)
    written = F.when(F.col("k") == 0, F.concat("code", F.lit(" Works"))).when(F.col("k") == 1, F.concat("code", F.lit(" ZQ"))).otherwise(F.concat("code", F.lit("qqqqqqqqqqqqqqqq")))
    rows = c.select(F.col("id").alias("row_id"), written.alias("company"), F.lit(None).cast("string").alias("email"))
    records = c.filter("k = 0").select("id", F.concat("code", F.lit(" works Inc.")).alias("name"), F.lit(None).cast("string").alias("domain"))
    return matching.match_companies(rows, records).select("row_id", "id", F.round("score", 6).alias("score"), "action")
