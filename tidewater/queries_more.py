"""More registered queries: names, gates, survivorship, joins and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions import casing, names, phone, records
from tidewater.operators import dedup, lookup, matching, quality, reports, survivorship
from tidewater.plans import flows
from tidewater import queries as base
from tidewater.queries import MD, RATE, SQL, _in_group, _master_and_duplicate, companies, facts, on_facts, oracle, query, table
from tidewater.sources import tables

# Names

TITLE = """CASE c_custkey % 6 WHEN 0 THEN concat('ACME CORP OF THE ', c_mktsegment) WHEN 1 THEN concat('the bank-of-', lower(c_mktsegment), ' and CO (US)') WHEN 2 THEN concat('eBay FedEx  LEARN b2b A.B.C. ', c_name)
  WHEN 3 THEN concat('  t-MOBILE/and ', c_mktsegment) WHEN 4 THEN '' ELSE NULL END"""
SMALL = ", ".join(f"'{w}'" for w in casing.CONJUNCTIONS)
CASED = rf"""CASE WHEN trim(t) = '' THEN t ELSE array_to_string(list_transform(tk, lambda x, i: CASE WHEN regexp_full_match(x, '\s+') THEN ' ' WHEN regexp_full_match(x, '[()/&,.-]') THEN x
  WHEN lower(x) = 'acme' THEN 'AcMe' WHEN lower(x) IN ({SMALL}) AND NOT (i = 1 OR (i > 1 AND tk[i - 1] = '-')) THEN lower(x)
  WHEN lower(x) NOT IN ({SMALL}) AND (regexp_matches(x, '^[A-Z]{{1,3}}$|^[A-Z](\.[A-Z])+\.?$|\d|^[A-Z]?[a-z]+[A-Z][a-z]+$') OR (regexp_matches(x, '^[A-Z]{{4,5}}$') AND mixed)) THEN x
  ELSE upper(substr(x, 1, 1)) || lower(substr(x, 2)) END), '') END"""


@query(rf"""SELECT c_custkey, {CASED} AS cased, t IS NOT NULL AND coalesce(({CASED.replace("WHEN lower(x) = 'acme' THEN 'AcMe' ", "")}) = t, false) AS already
  FROM (SELECT *, regexp_extract_all(trim(t), '\s+|[()/-]|[^\s()/-]+') AS tk, regexp_matches(trim(t), '[a-z]') AND regexp_matches(trim(t), '[A-Z]') AS mixed FROM (SELECT c_custkey, {TITLE} AS t FROM customer))""")
def functions_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24, and its test of F57, on names with small words, hyphens, acronyms, digits and brands."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{TITLE} AS t")
    return c.select("c_custkey", casing.smart_title_case(F.col("t"), brands={"acme": "AcMe"}).alias("cased"), casing.is_smart_title_case(F.col("t")).alias("already"))


FOUR = "lpad(cast(c_custkey % 10000 as string), 4, '0')"
FOREIGN = f"CASE c_custkey % 3 WHEN 0 THEN concat('+44 (20) 7946-', {FOUR}) WHEN 1 THEN concat('+61 2 9374 ', {FOUR}, ' ext. 12') ELSE concat('+49 30/1234', {FOUR}) END"


@query(f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+44207946' || f WHEN 1 THEN '+6129374' || f ELSE '+49301234' || f END AS compact, CASE c_custkey % 3 WHEN 0 THEN '+44 20-7946-' || f WHEN 1 THEN '+61 2-9374-' || f ELSE '+49 3012-34' || left(f, 1) || '-' || right(f, 3) END AS dashes,
  CASE c_custkey % 3 WHEN 0 THEN '(207) 946-' || f WHEN 1 THEN '29374' || f ELSE '(301) 234-' || f END AS national FROM (SELECT c_custkey, {FOUR.replace('as string', 'AS VARCHAR')} AS f FROM customer)""")
def functions_phone_abroad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20 and F21 on British, Australian and German numbers."""
    p = F.expr(FOREIGN)
    return table(spark, sf_dir, "customer").select("c_custkey", phone.e164(p).alias("compact"), phone.e164(p, "e164_dashes").alias("dashes"), phone.e164(p, "national").alias("national"))


SIM = "CASE WHEN lower({0}) = lower({1}) THEN 1.0::DOUBLE ELSE 1 - levenshtein(lower({0}), lower({1}))::DOUBLE / greatest(length({0}), length({1})) END"
WORDS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@query(oracle(rf"""SELECT id, made AS output, round(greatest(0, (CASE WHEN NOT s AND NOT e THEN 0.95 WHEN s THEN 0.9 ELSE 1.0 END) - CASE WHEN {SIM.format('n', 'made')} < 0.7 THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS confidence, CASE WHEN contacts = 4 THEN 'registry' ELSE 'rules' END AS source
  FROM (SELECT *, regexp_matches(q, '(?i)\sinc\.$') AS e, regexp_replace(q, '(?i)\sinc\.$', ' Inc') AS made FROM (SELECT *, CASE WHEN s THEN {WORDS.format('one')} ELSE one END AS q FROM (SELECT *, one = upper(one) AND length(one) > 3 AS s FROM (
    SELECT id, contacts, n, trim(regexp_replace(n, '\s+', ' ', 'g')) AS one FROM (SELECT id, contacts, CASE WHEN contacts = 0 THEN upper(name) ELSE name END AS n FROM companies)))))
  WHERE contacts <> 4 UNION ALL SELECT id, 'Acme', 1.0, 'registry' FROM companies WHERE contacts = 4"""))
def functions_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names by rules, or as a registry has them."""
    c = companies(spark, sf_dir).withColumn("n", F.when(F.col("contacts") == 0, F.upper("name")).otherwise(F.col("name")))
    made = casing.company_name(F.col("n"), registered=F.when(F.col("contacts") == 4, "Acme"))
    return c.select("id", made.alias("m")).select("id", "m.output", F.round("m.confidence", 4).alias("confidence"), "m.source")


SEG = "lower(c_mktsegment)"
CAP = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
MAC = f"replace({CAP}, 'Machinery', 'MacHinery')"
PERSON = f"CASE c_custkey % 9 WHEN 0 THEN concat('mc', {SEG}) WHEN 1 THEN concat('MAC', c_mktsegment) WHEN 2 THEN concat('o''', {SEG}) WHEN 3 THEN concat('van der ', {SEG}) WHEN 4 THEN concat('ibn  ', {SEG}) WHEN 5 THEN concat('al ', {SEG}) WHEN 6 THEN concat('EL-', c_mktsegment) WHEN 7 THEN concat({SEG}, ' jr.') ELSE concat(' ', c_mktsegment, ' ') END"


@query(f"""SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Mc' || {CAP} WHEN 1 THEN 'Mac' || {CAP} WHEN 2 THEN 'O''' || {CAP} WHEN 3 THEN 'van der ' || {CAP} WHEN 4 THEN 'ibn ' || {CAP} WHEN 5 THEN 'al-' || {CAP} WHEN 6 THEN 'el-' || {CAP} WHEN 7 THEN {MAC} || ' Jr' ELSE {MAC} END AS output,
  CASE WHEN c_custkey % 9 IN (1, 6, 8) THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence FROM customer""")
def functions_person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surnames with prefixes, particles and ends."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{PERSON} AS n")
    return c.select("c_custkey", casing.person_name(F.col("n"), last=True).alias("m")).select("c_custkey", "m.output", F.round("m.confidence", 4).alias("confidence"))


JOBS = ("Chief Revenue Officer", "CTO & Co-Founder", "Executive Vice President", "SVP Sales", "Assistant to the VP", "V.P. Finance", "Owner", "Head of Growth", "Clinical Supervisor", "Team Lead", "Account Executive", "Consultant", "Sales Rep", "Staff Nurse", "Gardener", " ", "President of the Vice Squad", "Analyst", "Analyst to a senior", "Designer of the head office", "Principal", "Clinical Director", "Sales Manager")
JOB = "list_extract([" + ", ".join(f"'{j}'" for j in JOBS) + f"], (c_custkey % {len(JOBS)})::INT + 1)"
def _level_sql() -> str:
    """The table of titles as SQL on padded text l: a title stands between blanks, and none of its exceptions follows."""
    def says(w: str) -> str:
        has = f"' ' || l || ' ' LIKE '% {w} %'"
        return has if w not in names.UNLESS_FOLLOWED else "(" + has + "".join(f" AND l NOT LIKE '%{w}% {x}%'" for x in names.UNLESS_FOLLOWED[w]) + ")"

    either = lambda words: " OR ".join(map(says, words))
    ranks = " OR ".join(f"' ' || l || ' ' LIKE '% {w} %'" for w in names.RANKS)
    return "CASE WHEN trim(t) = '' THEN 'Other' " + " ".join(f"WHEN {either(titles)} THEN '{level}'" for level, titles in names.TITLES) + f" WHEN ({either(names.EXPERIENCED)}) AND NOT ({ranks}) THEN 'IC' ELSE 'Other' END"


LEVEL = _level_sql()


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.get(F.array(*map(F.lit, JOBS)), (F.col("c_custkey") % len(JOBS)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", title.alias("title"))


@query(f"SELECT c_custkey, {LEVEL} AS level FROM (SELECT c_custkey, t, lower(trim(t)) AS l FROM (SELECT c_custkey, {JOB} AS t FROM customer))")
def functions_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F49."""
    return _jobs(spark, sf_dir).select("c_custkey", names.job_level(F.col("title")).alias("level"))


@query(f"SELECT v.level, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['C-Suite', 'EVP / SVP', 'VP', 'Director', 'Manager', 'IC', 'Founder', 'Other', 'Needs Review']) AS level) v LEFT JOIN (SELECT {LEVEL} AS level, count(*) AS n FROM (SELECT t, lower(trim(t)) AS l FROM (SELECT {JOB} AS t FROM customer)) GROUP BY 1) USING (level)")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by level, zero-filled."""
    return reports.level_histogram(_jobs(spark, sf_dir), "title")


# Pairs, gates, survivorship

def _band(c: str) -> str:
    return "CASE WHEN {0} <= 0 THEN NULL WHEN {0} <= 10 THEN 0 WHEN {0} <= 50 THEN 1 WHEN {0} <= 200 THEN 2 WHEN {0} <= 500 THEN 3 WHEN {0} <= 1000 THEN 4 ELSE 5 END".format(c)


HOST2 = "nullif(regexp_replace(lower(regexp_extract({0}, '^(https?://)?([^/]+)', 2)), '^www\\.', ''), '')"
FIRM = "firm AS (SELECT *, contacts * 400 AS size, " + HOST2.format("domain") + " AS host, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS digits FROM companies)"
COMPOSITE = (
    "round(0.5 * coalesce((x.host = y.host)::INT, 0) + 0.25 * (" + SIM.format("x.name", "y.name") + ") + 0.1 * CASE WHEN x.digits <> '' AND y.digits <> '' THEN (" + SIM.format("x.digits", "y.digits") + ") ELSE 0 END"
    " + 0.08 * (" + SIM.format("x.industry", "y.industry") + f") + 0.07 * coalesce(CASE abs({_band('x.size')} - {_band('y.size')}) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 END, 0), 6)"
)


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies(spark, sf_dir).withColumn("employees", F.col("contacts") * 400)


@query(oracle(f"SELECT x.id AS a, y.id AS b, {COMPOSITE} AS score FROM firm x JOIN firm y ON x.grp = y.grp AND x.id < y.id", FIRM))
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 on the variants of one company."""
    c = _firms(spark, sf_dir)
    side = lambda n: c.select("grp", F.col("id").alias(n), F.struct(*c.columns).alias(f"r{n}"))
    return side("a").join(side("b"), "grp").filter("a < b").select("a", "b", V.round_half_up(dedup.composite_similarity(F.col("ra"), F.col("rb")), 6).alias("score"))


K3 = "substr({0}, 2)::BIGINT % 3"
GATE = f"""cand AS (SELECT x.id AS row_id, y.id, y.parent_id, y.name AS rival, {COMPOSITE} AS score, x.known_id FROM (SELECT *, CASE WHEN grp % 5 = 0 THEN id END AS known_id FROM firm WHERE {K3.format('id')} = 1) x JOIN (SELECT *, CASE WHEN grp % 7 = 0 THEN 'p' WHEN grp % 10 = 5 THEN 'c' || lpad((grp + 1)::VARCHAR, 9, '0') END AS parent_id FROM firm WHERE {K3.format('id')} = 0) y
  ON x.host = y.host OR (x.grp = y.grp AND NOT EXISTS (SELECT 1 FROM firm z WHERE {K3.format('z.id')} = 0 AND z.host = x.host)) WHERE y.id IS DISTINCT FROM x.known_id),
top AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, id) = 1),
gated AS (SELECT f.id AS row_id, CASE WHEN f.grp % 5 = 0 THEN 'upsert' WHEN top.id IS NULL THEN 'insert' WHEN top.parent_id IS NOT NULL THEN 'skip' WHEN score >= 0.6 THEN 'review' ELSE 'insert' END AS action, f.grp, top.id AS target, score, top.parent_id, rival, coalesce(score >= 0.6 AND top.parent_id IS DISTINCT FROM f.id, false) AS warned FROM firm f LEFT JOIN top ON top.row_id = f.id WHERE {K3.format('f.id')} = 1)"""


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _firms(spark, sf_dir)
    k = F.substring("id", 2, 9).cast("bigint") % 3
    rows = c.filter(k == 1).withColumn("known_id", F.when(F.col("grp") % 5 == 0, F.col("id"))).withColumnRenamed("id", "row_id")
    return rows, matching.gate(rows, c.filter(k == 0).withColumn("parent_id", F.expr("CASE WHEN grp % 7 = 0 THEN 'p' WHEN grp % 10 = 5 THEN concat('c', lpad(cast(grp + 1 AS string), 9, '0')) END")))


@query(oracle("""SELECT row_id, action, CASE WHEN action = 'upsert' THEN row_id WHEN action IN ('skip', 'review') THEN target END AS id, CASE WHEN action <> 'upsert' OR warned THEN score END AS score,
  CASE WHEN action = 'upsert' AND warned THEN 'Potential duplicate found: ' || coalesce(rival, '') || ' (' || floor(score * 100 + 0.5)::INT::VARCHAR || '% similar)' WHEN action = 'skip' THEN 'Parent-child suppression: matched company ' || target || ' is a child of ' || parent_id || '. Manual review required.' END AS warning FROM gated""", FIRM, GATE))
def write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert, insert, review or skip by the most similar candidate of the domain, else of the name."""
    return _gated(spark, sf_dir)[1]


@query(oracle("SELECT action, CASE WHEN action IN ('upsert', 'insert') THEN floor((r - 1) / 100)::BIGINT END AS batch, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY row_id) AS r FROM gated) GROUP BY ALL", FIRM, GATE))
def write_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a gated write, in batches of a hundred."""
    rows, gated = _gated(spark, sf_dir)
    return matching.write_plan(rows.select("row_id", "name"), gated).groupBy("action", "batch").agg(F.count("*").alias("n"))


FORM = "CASE WHEN length({0}) = 10 THEN '+1' ELSE '+' END || {0}"


@query(oracle(f"""SELECT x.id AS a, y.id AS b, CASE WHEN d THEN 'domain' WHEN p AND i THEN 'phone' END AS "group", CASE WHEN d OR (p AND i) THEN 100.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN d OR (p AND i) THEN 'A' ELSE 'D' END AS grade FROM (
  SELECT x, y, coalesce(x.domain <> '' AND y.domain <> '' AND split_part(regexp_replace(lower(x.domain), '^(https?://)?(www\\.)?', ''), '/', 1) = split_part(regexp_replace(lower(y.domain), '^(https?://)?(www\\.)?', ''), '/', 1), false) AS d,
    x.phone IS NOT NULL AND y.phone IS NOT NULL AND {FORM.format('x.digits')} = {FORM.format('y.digits')} AS p, lower(x.industry) = lower(y.industry) AS i FROM firm x JOIN firm y ON x.grp = y.grp AND x.id < y.id)""", FIRM))
def signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group of signals that holds."""
    c = companies(spark, sf_dir)
    side = lambda n: c.select("grp", F.col("id").alias(f"{n}_id"), F.struct(*c.columns).alias(n))
    groups = [{"id": "domain", "conditions": [{"field": "domain", "match_type": "normalized", "weight": 2}]}, {"id": "phone", "conditions": [{"field": "phone", "match_type": "normalized", "weight": 1}, {"field": "industry", "match_type": "exact", "weight": 1}]}]
    scored = dedup.score_by_groups(side("a").join(side("b"), "grp").filter("a_id < b_id"), groups)
    return scored.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "group", "confidence", "grade")


@query(oracle(f"SELECT x.id AS a, y.id AS b, CASE WHEN (x.host LIKE '%.com' AND y.host LIKE '%.com.au') OR (y.host LIKE '%.com' AND x.host LIKE '%.com.au') THEN 15.0 ELSE 0.0 END::DOUBLE AS penalty FROM firm x JOIN firm y ON x.grp = y.grp AND x.id < y.id", FIRM))
def tld_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured penalty for ends of domains that are often two firms."""
    c = dedup.comparable(companies(spark, sf_dir).withColumn("key", F.col("id"))).select("id", "host")
    g = companies(spark, sf_dir).select("id", "grp").join(c, "id")
    side = lambda n: g.select("grp", F.col("id").alias(n), F.col("host").alias(f"h{n}"))
    return side("a").join(side("b"), "grp").filter("a < b").select("a", "b", dedup.tld_penalty(F.col("ha"), F.col("hb"), [(".com", ".com.au"), (".com", ".co.uk")], 15).alias("penalty"))


PARENT = "CASE WHEN contacts IN (1, 2) THEN 'c1' WHEN contacts = 3 THEN 'c2' END"


@query(oracle(f"SELECT a, b, CASE WHEN p = b OR q = a THEN 'directly_linked' WHEN p = q THEN 'same_parent' WHEN p IS NOT NULL AND q IS NOT NULL THEN 'sibling' WHEN p IS NOT NULL OR q IS NOT NULL THEN 'one_has_parent' ELSE 'no_hierarchy' END AS relationship FROM (SELECT x.id AS a, y.id AS b, {PARENT.replace('contacts', 'x.contacts')} AS p, {PARENT.replace('contacts', 'y.contacts')} AS q FROM companies x JOIN companies y ON x.grp = y.grp AND x.id < y.id)"))
def parent_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    c = companies(spark, sf_dir).withColumn("parent_id", F.expr(PARENT))
    return lookup.relationship(_in_group(spark, sf_dir).select("a", "b"), c.select("id", "parent_id")).select("a", "b", "relationship")


@query(oracle(f"SELECT grp, first(id ORDER BY p IS NOT NULL, contacts DESC, id) AS survivor, CASE WHEN bool_or(p IS NULL) THEN 'parent_preferred' ELSE 'all_have_parents' END AS reason FROM (SELECT *, {PARENT} AS p FROM companies) GROUP BY grp"))
def parent_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that is nobody's child survives."""
    return survivorship.parent_aware(companies(spark, sf_dir).withColumn("parent_id", F.expr(PARENT)), "grp", [F.desc("contacts"), F.asc("id")])


RULES = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'org' || (c_custkey % 2)::VARCHAR ELSE '__default__' END AS org_id, 'f' || (c_custkey % 20)::VARCHAR AS field_key, 't' || (c_custkey % 7)::VARCHAR AS rule_type, c_custkey % 11 <> 0 AS is_active FROM customer)"


@query(f"SELECT id, org_id, field_key, rule_type FROM {RULES} r WHERE is_active AND (org_id = 'org1' OR (org_id = '__default__' AND NOT EXISTS (SELECT 1 FROM {RULES} o WHERE o.is_active AND o.org_id = 'org1' AND o.field_key = r.field_key AND o.rule_type = r.rule_type)))")
def survivor_rule_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rules, and the default ones that they leave."""
    k = F.col("c_custkey")
    rules = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("org"), (k % 2).cast("string"))).otherwise("__default__").alias("org_id"), F.concat(F.lit("f"), (k % 20).cast("string")).alias("field_key"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("rule_type"), (k % 11 != 0).alias("is_active"))
    return survivorship.load_rules(rules, "org1").select("id", "org_id", "field_key", "rule_type")


SRC = "list_position(['alpha', 'gamma'], CASE ({0})::INT % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'gamma' ELSE 'other' END)"
SEGS = "coalesce(list_position(['building', 'machinery'], lower({0})), 0)"


@query(oracle(f"""SELECT id, CASE WHEN coalesce({SRC.format('dc')}, 9) < coalesce({SRC.format('mc')}, 9) AND coalesce(de, '') <> '' THEN de ELSE me END AS by_source,
  CASE WHEN {SEGS.format('di')} > 0 AND ({SEGS.format('mi')} = 0 OR {SEGS.format('di')} < {SEGS.format('mi')}) THEN di ELSE mi END AS by_value, least(mc, dc)::DOUBLE AS least_, ((mc + dc) / 2)::DOUBLE AS mean,
  coalesce(da, '') = 'true' AND coalesce(ma, '') <> 'true' AS swapped FROM md""", MD))
def survivorship_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted sources, ranked values, least and mean, and a won deal that makes the duplicate the master."""
    p = _master_and_duplicate(spark, sf_dir)
    swapped = survivorship.closed_won(p.withColumns({s: F.col(s).withField("won", F.coalesce(F.col(s)["active"] == "true", F.lit(False))) for s in ("m", "d")})).select(F.when(F.col("swapped"), F.col("d.id")).otherwise(F.col("m.id")).alias("id"), "swapped")
    m, d = F.col("m"), F.col("d")
    source = lambda r: F.get(F.array(*map(F.lit, ("alpha", "gamma", "other"))), r["contacts"] % 3)
    made = p.select(
        m["id"].alias("id"), survivorship.choose("source_preference", m["email"], d["email"], source(m), source(d), order=["alpha", "gamma"]).alias("by_source"), survivorship.choose("specific_value", m["industry"], d["industry"], order=["BUILDING", "machinery"]).alias("by_value"),
        survivorship.choose("rollup", m["contacts"], d["contacts"], how="min").cast("double").alias("least_"), survivorship.choose("rollup", m["contacts"], d["contacts"], how="average").cast("double").alias("mean"),
    )
    return made.join(swapped, "id")


SNAP = ["domain", "phone", "email"]


@query(oracle("SELECT grp AS cluster, id, " + " || ".join(f"CASE WHEN {f} <> '' THEN '{f}=' || {f} || ';' ELSE '' END" for f in ("domain", "email", "phone")).replace("CASE WHEN domain", "CASE WHEN coalesce(domain, '')").replace("CASE WHEN email", "CASE WHEN coalesce(email, '')").replace("CASE WHEN phone", "CASE WHEN coalesce(phone, '')").replace("|| domain ||", "|| coalesce(domain, '') ||").replace("|| email ||", "|| coalesce(email, '') ||").replace("|| phone ||", "|| coalesce(phone, '') ||") + " AS properties FROM companies"))
def merge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each member of a cluster was before a merge."""
    c = companies(spark, sf_dir)
    clustered = c.groupBy(F.col("grp").alias("cluster")).agg(F.array_sort(F.collect_list("id")).alias("record_ids"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return survivorship.snapshots(clustered, c, SNAP).select("cluster", "id", text.alias("properties"))


@query(oracle("SELECT grp AS cluster, array_to_string(list_sort(list_filter([CASE WHEN bool_or(coalesce(domain, '') <> '') THEN 'domain' END, CASE WHEN bool_or(coalesce(phone, '') <> '') THEN 'phone' END, CASE WHEN bool_or(coalesce(email, '') <> '') THEN 'email' END], lambda x: x IS NOT NULL)), ',') AS fields FROM companies GROUP BY grp"))
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields that any member of a cluster has."""
    c = companies(spark, sf_dir)
    clustered = c.groupBy(F.col("grp").alias("cluster")).agg(F.collect_list("id").alias("record_ids"))
    return survivorship.field_universe(survivorship.snapshots(clustered, c, SNAP), "cluster").select("cluster", F.array_join("fields", ",").alias("fields"))


@query("SELECT row_id, contact_id, CASE WHEN method = 'none' THEN 'c' || lpad((substr(row_id, 2)::BIGINT - 1)::VARCHAR, 9, '0') END AS company_id, CASE WHEN method = 'none' THEN 'company_fuzzy' ELSE method END AS method, 1.0::DOUBLE AS confidence, 'match' AS action FROM (" + SQL["contact_matches"] + ") WHERE substr(row_id, 2)::BIGINT % 3 = 1")
def contact_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mail, by profile, then to the company of the most similar name; names of one group are the same but for their form."""
    number = "cast(cast(floor(grp / 3) as bigint) as string)"
    whole = f"translate(lpad({number}, greatest(4, length({number})), '0'), '0123456789', 'abcdefghij')"  # CODE comes again from 10,000 groups on
    c = companies(spark, sf_dir).withColumn("name", F.expr(base.FIRM_NAME.replace(base.CODE, whole)))
    k = F.substring("id", 2, 9).cast("bigint")
    rows = c.filter(k % 3 == 1).select(F.col("id").alias("row_id"), "email", "linkedin", F.col("name").alias("company"))
    return matching.match_contacts(rows, companies(spark, sf_dir).filter(k % 2 == 0), c.filter(k % 3 == 0).select("id", "name", "domain"))


# Joins

@query("SELECT a.h AS rule_id, a.f AS field, b.h AS other_id, 'Rule ' || b.h AS other_name FROM (SELECT DISTINCT 'h' || (c_custkey % 40)::VARCHAR AS h, 'f' || (c_custkey % 28)::VARCHAR AS f FROM customer WHERE c_custkey % 40 % 5 <> 0 AND c_custkey % 40 % 3 <> 2) a JOIN (SELECT DISTINCT 'h' || (c_custkey % 40)::VARCHAR AS h, 'f' || (c_custkey % 28)::VARCHAR AS f FROM customer WHERE c_custkey % 40 % 5 <> 0 AND c_custkey % 40 % 3 <> 2) b ON a.f = b.f AND a.h <> b.h")
def rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rules, own or common, that write one field."""
    rules = spark.range(40).select(F.concat(F.lit("h"), "id").alias("id"), F.concat(F.lit("Rule h"), "id").alias("name"), F.when(F.col("id") % 3 == 1, "o1").when(F.col("id") % 3 == 2, "o2").alias("org_id"), (F.col("id") % 5 != 0).alias("is_active"))
    k = F.col("c_custkey")
    assigned = table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), (k % 40).cast("string")).alias("rule_id"), F.concat(F.lit("f"), (k % 28).cast("string")).alias("field")).distinct()
    return lookup.field_conflicts(rules, assigned, "o1")


@query("SELECT c_custkey, coalesce(p, 0)::DOUBLE AS price, coalesce(k, 0)::BIGINT AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey")
def latest_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its latest finished order, 0 without one."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("last_order"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return lookup.with_latest(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "at", ["price", "last_order"])


TIERS = ("internal", "starter", "trial", "trial", "scale", "none")
USAGE = "(SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id)"


@query(f"""SELECT s_suppkey AS org_id, coalesce(p, 0)::BIGINT AS purchase_used, greatest(5 - coalesce(p, 0), 0)::BIGINT AS purchase_remaining, coalesce(c, 0)::BIGINT AS click_used, greatest(3 - coalesce(c, 0), 0)::BIGINT AS click_remaining,
  CASE s_suppkey % 6 WHEN 0 THEN true WHEN 1 THEN s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 WHEN 4 THEN s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 WHEN 5 THEN false ELSE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 > 0 AND greatest(5 - coalesce(p, 0), 0) >= 2 END AS allowed
  FROM supplier LEFT JOIN {USAGE} ON user_id = s_suppkey""")
def plan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use by organisation, what remains of a plan, and whether an action may pass."""
    k = F.col("s_suppkey")
    orgs = table(spark, sf_dir, "supplier").select(k.alias("org_id"), F.get(F.array(*map(F.lit, TIERS)), (k % 6).cast("int")).alias("tier"), F.when(k % 4 == 0, "cancelled").otherwise("active").alias("status"), (k % 5 == 0).alias("grace_expired"), (k % 3).alias("trial_days"))
    usage = table(spark, sf_dir, "events").select(F.col("user_id").alias("org_id"), F.col("event_type").alias("kind"), F.lit(1).cast("bigint").alias("amount"), F.col("ts").alias("at"))
    out = reports.entitlements(orgs, usage, F.lit("1970-01-01").cast("timestamp"), ("purchase", "click"), {"purchase": 5, "click": 3})
    allowed = records.may_act(F.col("tier"), F.col("status"), F.col("grace_expired"), F.col("trial_days"), F.col("purchase_remaining"), F.lit(2))
    return out.select("org_id", "purchase_used", "purchase_remaining", "click_used", "click_remaining", allowed.alias("allowed"))


@query(oracle("SELECT id, max(p) FILTER (f = 'name') AS source_name, max(p) FILTER (f = 'phone') AS source_phone FROM (SELECT c.id, CASE l_linenumber % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'phone' ELSE 'x' END AS f, 'p' || (l_suppkey % 5)::VARCHAR AS p FROM companies c LEFT JOIN lineitem ON l_partkey = substr(c.id, 2)::BIGINT) GROUP BY id"))
def value_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each field's value came from, as columns."""
    n = F.col("l_linenumber") % 3
    sources = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("id"), F.when(n == 0, "name").when(n == 1, "phone").otherwise("x").alias("field"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("source"))
    return lookup.field_sources(companies(spark, sf_dir).select("id"), sources, ["name", "phone"])


@query(oracle("SELECT 'domain' AS kind, host AS key, min(id) AS id FROM firm WHERE host IS NOT NULL GROUP BY host UNION ALL SELECT 'phone', digits, min(id) FROM firm WHERE digits <> '' GROUP BY digits", FIRM))
def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index of several keys to records."""
    from tidewater.functions.phone import digits
    from tidewater.functions.text import extract_domain

    return lookup.key_index(companies(spark, sf_dir), {"domain": extract_domain(F.col("domain")), "phone": digits(F.col("phone"))})


TAXONOMY = "(SELECT 't' || lpad(p_partkey::VARCHAR, 9, '0') AS key, lpad((p_partkey % 500)::VARCHAR, 4, '0') AS code_4, [lpad((p_partkey % 3000)::VARCHAR, 6, '0'), lpad((p_partkey % 1700 + 5000)::VARCHAR, 6, '0')] AS codes_6, p_name AS label, p_type AS description FROM part)"


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("t"), pad(k, 9)).alias("key"), pad(k % 500, 4).alias("code_4"), F.array(pad(k % 3000, 6), pad(k % 1700 + 5000, 6)).alias("codes_6"), F.col("p_name").alias("label"), F.col("p_type").alias("description"))


CODES = "(SELECT DISTINCT lpad((c_custkey % 900)::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 6 END, '0') AS code FROM customer)"


@query(f"SELECT c.code, min(t.key) AS key FROM {CODES} c LEFT JOIN {TAXONOMY} t ON t.code_4 = c.code OR list_contains(t.codes_6, c.code) GROUP BY c.code")
def industry_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four- and six-digit codes to the taxonomy's keys."""
    k = F.col("c_custkey")
    code = F.when(k % 2 == 0, F.lpad((k % 900).cast("string"), 4, "0")).otherwise(F.lpad((k % 900).cast("string"), 6, "0"))
    return lookup.by_code(table(spark, sf_dir, "customer").select(code), _taxonomy(spark, sf_dir))


@query(f"SELECT key, label, lower(concat_ws(' ', label, description)) LIKE '%ring econ%' AS whole, label ILIKE '%widget%' OR description ILIKE '%small%' AS any_field FROM {TAXONOMY} WHERE lower(concat_ws(' ', label, description)) LIKE '%ring econ%' OR label ILIKE '%widget%' OR description ILIKE '%small%'")
def taxonomy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in all fields together, or in any of them."""
    t = _taxonomy(spark, sf_dir)
    a = lookup.taxonomy_search(t, "RING Econ", ["label", "description"]).select("key").withColumn("whole", F.lit(True))
    b = lookup.ilike_any(t.select("key", "label"), ["label"], "Widget").select("key").unionByName(lookup.ilike_any(t.select("key", "description"), ["description"], "Small").select("key")).distinct().withColumn("any_field", F.lit(True))
    hit = a.join(b, "key", "full")
    return t.select("key", "label").join(hit, "key").select("key", "label", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("any_field", F.lit(False)).alias("any_field"))


@query(oracle(f"SELECT c.id FROM companies c JOIN (SELECT c_custkey, {LEVEL} AS level FROM (SELECT c_custkey, t, lower(trim(t)) AS l FROM (SELECT c_custkey, {JOB} AS t FROM customer))) j ON j.c_custkey = substr(c.id, 2)::BIGINT WHERE level IN ('VP', 'IC') AND lower(name) LIKE '%works%' AND lower(coalesce(email, '')) NOT LIKE '%gmail%' AND industry IN ('BUILDING', 'MACHINERY')"))
def import_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of an import, one of them on the level of a title."""
    c = companies(spark, sf_dir).withColumn("c_custkey", F.substring("id", 2, 9).cast("bigint")).join(_jobs(spark, sf_dir), "c_custkey")
    return c.filter(flows.row_filter({"title": ["VP", "IC"], "name": {"contains": "WORKS"}, "email": {"not_contains": "Gmail"}, "industry": ["BUILDING", "MACHINERY"]}, title="title")).select("id")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linenumber = 2)")
def signal_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of structs that hold one of a type, and arrays that hold a value."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("type"))).alias("signals"), F.collect_list("l_linenumber").alias("ids"))
    return x.filter(flows.has_signal(F.col("signals"), "R") & F.array_contains("ids", 2)).select("l_orderkey")


# Flows over providers

def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    empty = F.create_map().cast("map<string,string>")
    row = lambda p, data, error, ms: F.struct(F.lit(p).alias("provider"), data.alias("data"), error.alias("error"), ms.cast("int").alias("duration_ms"))
    return table(spark, sf_dir, "customer").select(k.alias("case"), F.explode(F.array(
        row("a", F.when(k % 4 == 0, empty).otherwise(F.create_map(F.lit("name"), F.lit("x"))), F.when(k % 4 == 0, "timeout"), k % 7),
        row("b", F.when(k % 3 == 0, F.create_map(F.lit("phone"), F.lit("1"))).otherwise(empty), F.lit(None).cast("string"), k % 5),
        row("c", F.create_map(F.lit("email"), F.lit("e")), F.lit(None).cast("string"), k % 3),
    )).alias("x")).select("case", "x.*")


CASCADE = [{"provider": "a"}, {"provider": "b", "trigger": "on_error"}, {"provider": "c", "trigger": "on_missing_field", "config": {"field": "phone"}}, {"provider": "a", "trigger": "on_field_present", "config": {"field": "email"}}, {"provider": "b", "trigger": "on_empty"}]
SIM_SQL = """WITH k AS (SELECT c_custkey AS k FROM customer),
s AS (SELECT k, true AS t0, k % 4 = 0 AS t1, NOT (k % 4 = 0 AND k % 3 = 0) AS t2 FROM k),
u AS (SELECT *, t2 AS t3, CASE WHEN t2 THEN k % 4 = 0 ELSE true END AS t4 FROM s),
steps AS (SELECT k AS "case", 0 AS position, 'a' AS provider, t0 AS triggered, CASE WHEN k % 4 = 0 THEN '' ELSE 'name' END AS fields, CASE WHEN k % 4 = 0 THEN 'timeout' END AS error, (k % 7)::INT AS duration_ms FROM u
  UNION ALL SELECT k, 1, 'b', t1, CASE WHEN t1 AND k % 3 = 0 THEN 'phone' ELSE '' END, NULL, CASE WHEN t1 THEN k % 5 ELSE 0 END::INT FROM u
  UNION ALL SELECT k, 2, 'c', t2, CASE WHEN t2 THEN 'email' ELSE '' END, NULL, CASE WHEN t2 THEN k % 3 ELSE 0 END::INT FROM u
  UNION ALL SELECT k, 3, 'a', t3, CASE WHEN t3 AND k % 4 <> 0 THEN 'name' ELSE '' END, CASE WHEN t3 AND k % 4 = 0 THEN 'timeout' END, CASE WHEN t3 THEN k % 7 ELSE 0 END::INT FROM u
  UNION ALL SELECT k, 4, 'b', t4, CASE WHEN t4 AND k % 3 = 0 THEN 'phone' ELSE '' END, NULL, CASE WHEN t4 THEN k % 5 ELSE 0 END::INT FROM u) """


@query(SIM_SQL + "SELECT * FROM steps")
def cascade_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of providers over test cases, state growing from step to step."""
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), F.create_map().cast("map<string,string>").alias("data"))
    return flows.simulate(cases, CASCADE, _answers(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


@query(SIM_SQL + "SELECT count(*) AS tests, count(*) FILTER (r = 5) AS all_reached, count(*) FILTER (r < 5) AS early_exits, sum(e)::BIGINT AS errors, floor(sum(ms) / (count(*) * 5) + 0.5) AS avg_ms FROM (SELECT \"case\", count(*) FILTER (triggered) AS r, count(error) AS e, sum(duration_ms) AS ms FROM steps GROUP BY \"case\")")
def cascade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31."""
    return reports.cascade_report(cascade_steps(spark, sf_dir), len(CASCADE))


PULLED = "pulled AS (SELECT id AS record_id, 'employees' AS field, 'a' AS provider, employees AS value, 0 AS position FROM companies WHERE trim(coalesce(employees, '')) <> '' UNION ALL SELECT id, 'employees', 'b', (contacts * 10)::VARCHAR, 1 FROM companies WHERE deals > 0 UNION ALL SELECT id, 'state', 'b', state, 1 FROM companies WHERE trim(coalesce(state, '')) <> '' AND deals > 0)"


def _pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = companies(spark, sf_dir)
    a = c.select(F.col("id").alias("record_id"), "employees")
    b = c.filter("deals > 0").select(F.col("id").alias("record_id"), (F.col("contacts") * 10).cast("string").alias("employees"), "state")
    return flows.pull({"a": a, "b": b}, ["employees", "state"])


@query(oracle("SELECT * FROM pulled", PULLED))
def provider_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from the tables of two providers with different columns."""
    return _pulled(spark, sf_dir)


@query(oracle("""SELECT c.id AS record_id, 'state' AS field, CASE WHEN cur IS NOT NULL THEN cur WHEN lower(trim(s)) = 'california' THEN 'CA' ELSE s END AS value, coalesce(cur, s) AS raw, CASE WHEN cur IS NOT NULL THEN 'existing' WHEN s IS NOT NULL THEN 'b' END AS source, cur IS NULL AND s IS NOT NULL AS written
  FROM (SELECT id, CASE WHEN contacts = 0 THEN 'TX' END AS cur, CASE WHEN deals > 0 AND trim(coalesce(state, '')) <> '' THEN state END AS s FROM companies) c"""))
def waterfall_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A waterfall that fills empty fields, then a lookup of what it found."""
    current = companies(spark, sf_dir).select(F.col("id").alias("record_id"), F.lit("state").alias("field"), F.when(F.col("contacts") == 0, "TX").alias("value"))
    reference = spark.createDataFrame([("California", "CA", None, True, False)], "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    return flows.field_waterfall(_pulled(spark, sf_dir).filter("field = 'state'"), current, "fill_empty", reference=reference)


@query(oracle("SELECT record_id, 'employees' AS field, max(n)::VARCHAR AS value, max(n)::VARCHAR AS raw, 'max' AS source, true AS written FROM (SELECT record_id, try_cast(regexp_extract(ltrim(value), '^[+-]?[0-9]+\\.?[0-9]*') AS DOUBLE) AS n FROM pulled WHERE field = 'employees') WHERE n IS NOT NULL GROUP BY record_id", PULLED))
def waterfall_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 with the largest number instead of the first."""
    return flows.field_waterfall(_pulled(spark, sf_dir).filter("field = 'employees'"), spark.createDataFrame([], "record_id string, field string, value string"), how="max")


XWALK = [("11", "Building", "BUILDING", "CONSTRUCTION"), ("22", "Cars", "AUTOMOBILE", "AUTOMOTIVE"), ("33", "Homes", None, "RETAIL")]
CODE = "CASE contacts WHEN 0 THEN '11' WHEN 1 THEN '99' WHEN 2 THEN '33' END"


@query(oracle(f"""SELECT id AS record_id, v AS industry, CASE WHEN v IS NULL THEN coalesce(l, industry) END AS fallback_industry, CASE WHEN v IS NULL THEN code END AS fallback_code FROM (
  SELECT id, industry, {CODE} AS code, CASE WHEN contacts IN (1, 3) THEN 'Odd' END AS l, coalesce(CASE {CODE} WHEN '11' THEN 'CONSTRUCTION' WHEN '33' THEN 'RETAIL' END, CASE industry WHEN 'BUILDING' THEN 'CONSTRUCTION' WHEN 'AUTOMOBILE' THEN 'AUTOMOTIVE' END) AS v FROM companies)"""))
def industry_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By code, by label, by the provider's label, else into fallback columns."""
    xwalk = spark.createDataFrame(XWALK, "naics_code string, naics_label string, source_label string, crm_value string")
    rows = companies(spark, sf_dir).select(F.col("id").alias("record_id"), F.expr(CODE).alias("naics_code"), F.when(F.col("contacts").isin(1, 3), "Odd").alias("naics_label"), F.col("industry").alias("provider_label"))
    return flows.industry_two_stage(rows, xwalk)


@query(oracle("""SELECT 'phone' AS field, count(*) FILTER (coalesce(phone, '') <> '' AND NOT regexp_matches(trim(phone), '^\\+[1-9][0-9]{6,14}$')) AS issues FROM companies
  UNION ALL SELECT 'linkedin', count(*) FILTER (linkedin <> '') FROM companies UNION ALL SELECT 'industry', count(*) FILTER (industry NOT IN ('BUILDING', 'MACHINERY')) FROM companies"""))
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that fail their format, or that no reference list has."""
    from tidewater.functions.phone import is_e164

    c = companies(spark, sf_dir)
    formats = flows.format_issues(c, {"phone": is_e164(F.col("phone")), "linkedin": casing.is_canonical_linkedin(F.col("linkedin"))})
    reference = spark.createDataFrame([("x", "Building", None, True), ("y", "Machinery", "o1", True), ("z", "Furniture", "o2", True), ("z", "Furniture", None, False)], "input_value string, canonical_value string, org_id string, is_active boolean")
    return formats.unionByName(flows.lookup_issues(c, "industry", reference, "o1").select(F.lit("industry").alias("field"), "issues"))


@query(on_facts("SELECT id, CASE WHEN status = 'compliant' AND id % 3 <> 1 AND rule_key IN ('h0', 'h1', 'h2') THEN 'stale' ELSE status END AS status FROM facts"))
def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compliant under another version of the rule than the present one."""
    f = facts(spark, sf_dir).withColumn("version", F.concat(F.lit("1."), (F.col("id") % 3).cast("string")))
    now = spark.createDataFrame([("h0", "1.1"), ("h1", "1.1"), ("h2", "1.1")], "rule_key string, version string")
    return flows.mark_stale(f, now, rule="rule_key").select("id", "status")


# Reports

RATES = f"rates AS (SELECT rule_key, {RATE} AS rate, count(*) FILTER (status = 'unprocessed') AS unprocessed, count(*) FILTER (status <> 'compliant') AS affected FROM facts WHERE rule_key IS NOT NULL GROUP BY rule_key)"
INSIGHTS = "insights AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'h' || (o_orderkey % 9)::VARCHAR END AS rule_key, 'gap ' || o_orderkey::VARCHAR AS message, (o_orderkey % 50)::BIGINT AS n, TIMESTAMP '2024-01-01 12:00:00' - to_minutes((o_orderkey % 120)::INT) AS created_at FROM orders)"


@query(on_facts("""SELECT *, row_number() OVER (ORDER BY impact DESC, rule_key NULLS FIRST, issue)::INT AS rank FROM (SELECT * FROM (
  SELECT i.rule_key, message AS issue, n AS affected, (n * CASE WHEN r.rule_key IS NOT NULL THEN 1.5 ELSE 1 END * CASE WHEN created_at > TIMESTAMP '2024-01-01 11:00:00' THEN 1.2 ELSE 1 END)::DOUBLE AS impact FROM insights i LEFT JOIN rates r USING (rule_key)
  UNION ALL SELECT rule_key, unprocessed::VARCHAR || ' unprocessed records', unprocessed, unprocessed::DOUBLE FROM rates WHERE rate < 80 AND unprocessed > 0) ORDER BY impact DESC, rule_key NULLS FIRST, issue LIMIT 3)""", RATES, INSIGHTS))
def remediation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three items of most impact."""
    k = F.col("o_orderkey")
    insights = table(spark, sf_dir, "orders").select(F.when(k % 3 != 0, F.concat(F.lit("h"), (k % 9).cast("string"))).alias("rule_key"), F.concat(F.lit("gap "), k.cast("string")).alias("message"), (k % 50).alias("n"), (F.lit("2024-01-01 12:00:00").cast("timestamp") - F.make_dt_interval(mins=(k % 120).cast("int"))).alias("created_at"))
    return reports.remediation(insights, quality.breakdown(facts(spark, sf_dir), "rule_key"), "rule_key", F.lit("2024-01-01 12:00:00").cast("timestamp"))


@query(on_facts("""SELECT 'rule_unmatched' AS type, 2 AS priority, rule_key AS subject, affected AS count FROM rates WHERE rate < 60 AND affected > 0
  UNION ALL SELECT 'grade_a_duplicates', 1, NULL, count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0 HAVING count(*) > 0 UNION ALL SELECT 'quarantine_pending', 1, NULL, count(*) FROM customer WHERE c_custkey % 7 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'enrichment_available', 3, NULL, arg_max(event_id % 90 + 1, ts) FROM events""", RATES))
def action_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do, by priority."""
    pairs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "A").otherwise("B").alias("grade"))
    held = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 == 0, "pending").otherwise("done").alias("status"))
    e = table(spark, sf_dir, "events")
    runs = e.select(F.lit("completed").alias("status"), (F.col("event_id") % 90 + 1).alias("processed"), F.col("ts").alias("completed_at"))
    return reports.actions(quality.breakdown(facts(spark, sf_dir), "rule_key"), "rule_key", pairs, held, runs, F.lit("1970-01-02").cast("timestamp"))


@query(oracle("SELECT DISTINCT id FROM companies WHERE phone IS NULL OR trim(coalesce(email, '')) = '' OR linkedin = '' ORDER BY id LIMIT 100"))
def records_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of all records with any issue."""
    c = companies(spark, sf_dir)
    return reports.with_any_issue([c.filter(F.col("phone").isNull()), c.filter(V.is_blank(F.col("email"))), c.filter(F.col("linkedin") == "")])


@query("SELECT 'p' || (l_suppkey % 5)::VARCHAR AS provider, count(*) AS tested, count(*) FILTER (l_partkey % 3 = 0 OR l_linenumber > 4) AS matched, count(*) FILTER (l_partkey % 3 = 0) AS with_name, count(*) FILTER (l_linenumber > 4) AS with_phone, floor(10000.0 * count(*) FILTER (l_partkey % 3 = 0 OR l_linenumber > 4) / count(*) + 0.5) / 100 / 100 AS match_rate FROM lineitem GROUP BY 1")
def provider_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rate and coverage by provider."""
    x = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("provider"), F.when(F.col("l_partkey") % 3 == 0, "n").alias("name"), F.when(F.col("l_linenumber") > 4, "1").otherwise("").alias("phone"))
    return reports.provider_coverage(x, ["name", "phone"])


@query("SELECT count(*) AS runs, sum(n)::BIGINT AS records, sum(q)::BIGINT AS filled, floor(sum(q) / count(*) + 0.5) AS per_run FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY l_orderkey)")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a map of counts, summed over all runs."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.create_map(F.lit("even"), F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))).cast("bigint"), F.lit("odd"), F.sum(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity"))).cast("bigint")).alias("filled"))
    return reports.map_totals(x, "filled", "n")


@query("SELECT event_type AS bucket, count(*) AS n, array_to_string((list(event_id ORDER BY event_id))[1:3], ',') AS samples FROM events GROUP BY event_type")
def import_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by bucket and the first three rows of each."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"), "event_id")
    return reports.bucket_samples(e, "bucket", "event_id").withColumn("samples", F.array_join(F.transform("samples", lambda s: s["event_id"].cast("string")), ","))


@query("SELECT (s_suppkey)::BIGINT AS position, CASE s_suppkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'gamma' ELSE 'new' END AS provider, (0.5 + CASE s_suppkey % 3 WHEN 0 THEN 2 + 3 + 2 WHEN 1 THEN 1 + 1 + 1 ELSE 4 + 5 + 4 END)::DOUBLE AS credits_per_record, ((0.5 + CASE s_suppkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 13 END) * 200)::DOUBLE AS total_credits FROM supplier")
def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of steps over two hundred records."""
    k = F.col("s_suppkey")
    steps = table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("position"), F.when(k % 3 == 0, "alpha").when(k % 3 == 1, "gamma").otherwise("new").alias("provider"), F.array(F.lit("domain"), F.lit("phone"), F.lit("other")).alias("fields"))
    costs = spark.createDataFrame([("alpha", "domain", 2.0), ("alpha", "phone", 3.0), ("gamma", "name", 9.0), ("default", "domain", 4.0), ("default", "phone", 5.0)], "provider string, field string, credits double")
    return reports.run_cost(steps, costs, 200, 0.5)


@query("SELECT event_type AS pattern, count(*) AS n, 'q' || arg_max(event_id, (ts, 'q' || event_id::VARCHAR))::VARCHAR AS latest, max(ts) AS last_at FROM events GROUP BY event_type")
def question_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pattern"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"), "ts")
    return reports.question_counts(e, "pattern", "question", "ts").withColumnRenamed("ts", "last_at")


@query(f"SELECT event_type AS rule_id, count(*) AS processed, count(*) FILTER (value > 50) AS written, count(*) FILTER (value <= 50) AS skipped, max(ts) AS last_at, count(*) FILTER (value > 50) / count(*) AS change_rate FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS GROUP BY event_type")
def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule wrote and skipped in the last days."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule_id"), F.when(F.col("value") > 50, "written").otherwise("skipped").alias("status"), F.col("ts").alias("written_at"))
    return reports.recent_stats(e, "rule_id", F.lit("2024-01-20").cast("timestamp"), 7)


@query("SELECT p_brand AS category, p_size % 3 AS entity, count(*) AS n FROM part GROUP BY ALL")
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications by category and entity."""
    specs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), (F.col("p_size") % 3).alias("entity"))
    return reports.library_counts(specs, "category", "entity")


@query("SELECT l_orderkey, count(*)::INT AS size FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5")
def clusters_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the length of an array, from five on."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ids"))
    return reports.by_length(x, "ids", least=5).drop("ids")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 10")
def recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten keys."""
    return reports.recent_keys(table(spark, sf_dir, "events"), "user_id", "ts")


@query(oracle("SELECT floor(greatest(0, least(100, 100 - 100.0 * count(*) FILTER (phone IS NULL) / count(*))) + 0.5) AS health FROM companies"))
def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return companies(spark, sf_dir).agg(F.count_if(F.col("phone").isNull()).alias("issues"), F.count("*").alias("n")).select(quality.health(F.col("issues"), F.col("n")).alias("health"))


@query("SELECT user_id, floor(sum(value) * 30 / 7 + 0.5) AS projected, greatest(floor(sum(value) * 30 / 7 + 0.5) - 2000, 0)::DOUBLE AS overage FROM events GROUP BY user_id")
def usage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period's use at the present pace."""
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("total"))
    return used.select("user_id", quality.projection(F.col("total"), F.lit(30), F.lit(7), F.lit(2000)).alias("p")).select("user_id", "p.projected", "p.overage")


# Records

SITE = "CASE c_custkey % 5 WHEN 0 THEN concat('https://www.Shop', {0}, '.com/home?x=1') WHEN 1 THEN 'localhost' WHEN 2 THEN concat(' shop', {0}, '.co.uk. ') WHEN 3 THEN '' ELSE NULL END"
ADDED = "CASE c_custkey % 7 WHEN 0 THEN concat('bad, http://alt', cast(c_custkey as string), '.io/x') WHEN 1 THEN 'nothing' ELSE NULL END"
CLEAN = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '^www\.', ''), '[/?].*$', ''), '\.$', ''), '')"
VALID = r"regexp_matches({0}, '(?i)^(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{{0,61}}[a-z0-9]$')"


@query(rf"""SELECT c_custkey, d AS domain, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ', DE' WHEN c_custkey % 4 = 1 THEN 'DE' END AS location, CASE WHEN d IS NOT NULL THEN 'domain-based' WHEN c_custkey % 3 > 0 THEN 'name-based' ELSE 'insufficient' END AS route FROM (
  SELECT *, coalesce(CASE WHEN {VALID.format('s')} THEN s END, CASE WHEN c_custkey % 7 = 0 THEN 'alt' || c_custkey::VARCHAR || '.io' END) AS d FROM (SELECT *, {CLEAN.format('site')} AS s FROM (SELECT c_custkey, c_mktsegment, {SITE.format('cast(c_custkey as string)').replace('as string', 'AS VARCHAR')} AS site FROM customer)))""")
def company_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first valid domain, a location, and the way to enrich."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", f"{SITE.format('cast(c_custkey as string)')} AS site", f"{ADDED} AS added")
    k = F.col("c_custkey")
    domain = records.company_domain(F.lit("no domain"), F.col("site"), F.col("added"))
    place = records.location(F.when(k % 4 == 0, F.col("c_mktsegment")), F.lit(" "), F.when(k % 4 <= 1, "DE"))
    out = c.select("c_custkey", domain.alias("domain"), place.alias("location"))
    return out.withColumn("route", records.route(F.col("domain"), F.when(k % 3 > 0, "x")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment ELSE c_name END AS out FROM customer""")
def structured_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the wanted entry of a structured value, its default, its first, or plain text."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("CA").alias("abbr")))).when(k % 4 == 1, F.to_json(F.struct(F.lit(1).alias("x"), F.col("c_name").alias("name")))).when(k % 4 == 2, F.to_json(F.struct(F.col("c_mktsegment").alias("other")))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", records.extract_output(raw, "abbr", "name").alias("out"))


@query(oracle("""SELECT id, industry NOT IN ('HOUSEHOLD', 'FURNITURE') AS valid, CASE industry WHEN 'AUTOMOBILE' THEN 'CAR' WHEN 'BUILDING' THEN 'CONS' END AS value, CASE industry WHEN 'MACHINERY' THEN NULL WHEN 'AUTOMOBILE' THEN 'enum_translated' WHEN 'BUILDING' THEN 'enum_translated' ELSE 'enum_mismatch' END AS reason,
  CASE WHEN contacts * 400 <= 50 THEN '11-50' WHEN contacts * 400 <= 1000 THEN '501-1000' ELSE '501-1000' END AS size FROM companies"""))
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values for an enum by mapping, value and label, and counts for a list of ranges."""
    made = records.enum_value(F.col("industry"), {"MACHINERY": "Machines", "CAR": "Automobile", "CONS": "Construction"}, {"BUILDING": "CONS", "FURNITURE": "WOOD"})
    return companies(spark, sf_dir).select("id", made.alias("m"), records.employee_enum(F.col("contacts") * 400, ["11-50", "501-1000"]).alias("size")).select("id", "m.*", "size")


@query("SELECT o_orderkey, CASE WHEN o_orderdate::DATE >= DATE '1995-06-15' THEN 'TODAY' WHEN o_orderdate::DATE = DATE '1995-06-14' THEN 'YESTERDAY' ELSE upper(strftime(o_orderdate, '%B ') || day(o_orderdate)::VARCHAR || strftime(o_orderdate, ', %Y')) END AS label, strftime(o_orderdate, '%b ') || day(o_orderdate)::VARCHAR || strftime(o_orderdate, ', %Y') AS short FROM orders")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F63."""
    return table(spark, sf_dir, "orders").select("o_orderkey", records.date_label(F.col("o_orderdate"), F.lit("1995-06-15 10:00:00").cast("timestamp")).alias("label"), records.short_date(F.col("o_orderdate")).alias("short"))


@query(oracle("SELECT id AS _id, name AS _label, name AS company_name, CASE WHEN employees IS NULL OR employees IN ('', 'abc') THEN NULL WHEN employees = '50-100' THEN NULL ELSE regexp_replace(employees, '[^0-9.-]', '', 'g')::DOUBLE END AS employee_count, state AS crm_state FROM companies"))
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a CRM's columns under canonical names."""
    c = companies(spark, sf_dir).select("id", "name", "employees", "state")
    return records.flat_record(c, {"name": "company_name", "employees": "employee_count"}, ("employee_count",))


@query('SELECT o_orderkey AS "oOrderkey", o_custkey AS "oCustkey" FROM orders')
def camel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F64."""
    return records.camel_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 2 AND l_returnflag <> 'A' AS same FROM lineitem")
def tolerant_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structs of numbers, texts and arrays, equal within a tolerance."""
    n = F.col("l_linenumber")
    a = F.struct(F.col("l_tax").alias("x"), F.array(F.col("l_discount"), n.cast("double")).alias("y"), F.col("l_returnflag").alias("z"))
    b = F.struct((F.col("l_tax") + F.when(n % 3 == 2, 0.01).otherwise(0.00001)).alias("x"), F.array(F.col("l_discount"), n.cast("double")).alias("y"), F.when(F.col("l_returnflag") == "A", "B").otherwise(F.col("l_returnflag")).alias("z"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", records.nearly_equal(F.col("a"), F.col("b"), rows.schema["a"].dataType).alias("same"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 4 <> 0")
def visible_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F73."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 4 == 0, False).when(F.col("p_size") % 4 == 1, True).alias("visible"))
    return records.segments(p, order="p_partkey").drop("visible")


@query(oracle("SELECT id FROM companies WHERE domain = 'company6.com' UNION ALL SELECT id FROM companies WHERE lower(name) LIKE '%works 9%'"))
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By domain, and by words of a name."""
    c = companies(spark, sf_dir)
    return tables.search(c, domain="company6.com").select("id").unionByName(tables.search(c, name="Works 9").select("id"))


@query("""SELECT 'demo-' || lpad(k::VARCHAR, 3, '0') AS id, 'Demo Company ' || (k + 1)::VARCHAR AS name, (10 * pow(3, k % 6))::INT AS employee_count, ['Software', 'Retail', 'Healthcare'][k % 3 + 1] AS industry FROM range(10) t(k)""")
def demo_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made companies, the same each time."""
    return tables.demo_companies(spark).select("id", "name", "employee_count", "industry")


@query("SELECT o_orderkey AS record_id, 'orders' AS provider, o_orderpriority AS priority, o_totalprice AS price FROM orders")
def provider_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's stored answers under our names."""
    return tables.provider_table(spark, f"{sf_dir}/orders.parquet", "orders", {"o_orderpriority": "priority", "o_totalprice": "price"}, "o_orderkey")
