"""Registered queries of rule specifications in the expression language, and of sounds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.sounds import double_metaphone
from tidewater.operators import lookup
from tidewater.plans import rules
from tidewater.queries import SPECS, companies, oracle, query, table

#: Amounts in words and signs, the same in both engines.
AMOUNT = "CASE grp % 8 WHEN 0 THEN concat(cast(1 + grp % 90 as string), ' million') WHEN 1 THEN concat('$', cast(2 + grp % 70 as string), 'K') WHEN 2 THEN concat('USD ', cast(grp % 50 as string), '.5 Billion') WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN concat(cast(1 + grp % 9 as string), ',500.25') WHEN 6 THEN 'about a thousand' ELSE 'unknown' END"

AMOUNTS = rules.checked({"id": "amount", "version": "1.0.0", "field": "amount", "language": "jsonata", "rules": [
    {"id": "none", "when": 'value = null or value = ""', "transform": "null"},
    {"id": "words", "when": '$match($lowercase(value), /(thousand|million|billion)/)', "transform": """(
        $low := $lowercase(value);
        $digits := $trim($replace($low, /[^0-9.]+/, " "));  /* what is left of the number */
        $number($split($digits, " ")[0]) * ($contains($low, "billion") ? 1000000000 : $contains($low, "million") ? 1000000 : 1000)
    )"""},
    {"id": "plain", "transform": "$parse_number(value)"},
], "tests": [{"name": "words", "input": "2.5 Billion", "expected": 2500000000}, {"name": "sign", "input": "$3K", "expected": 3000}, {"name": "a number", "input": 17.5, "expected": 17.5}, {"name": "none", "input": None, "expected": None}]})


@query(oracle(f"""SELECT id, CASE grp % 8 WHEN 0 THEN (1 + grp % 90)::VARCHAR || '000000' WHEN 1 THEN (2 + grp % 70)::VARCHAR || '000' WHEN 2 THEN ((grp % 50) * 1000000000 + 500000000)::BIGINT::VARCHAR
  WHEN 5 THEN (1 + grp % 9)::VARCHAR || '500.25' END AS amount, CASE WHEN grp % 8 IN (3, 4) THEN 'none' WHEN grp % 8 IN (0, 2) THEN 'words' ELSE 'plain' END AS rule FROM companies"""))
def expression_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R2 and the expression language: variables, conditionals, regular expressions; a number that cannot be read makes the rule fail and the next one is tried."""
    new, rule = rules.cascade(AMOUNTS)
    return companies(spark, sf_dir).selectExpr("id", f"{AMOUNT} AS amount").select("id", new.alias("amount"), rule.alias("rule"))


MAILS = rules.checked({"id": "mail", "version": "2.1.0", "field": "email", "language": "jsonata", "meta": {"kind": "company"}, "rules": [
    {"id": "none", "when": 'value = null or $trim(value) = ""', "transform": '{"kind": "none", "industry": $lowercase(record.industry)}'},
    {"id": "free", "when": '$lowercase($split(value, "@")[1]) in ["gmail.com", "aol.com"]', "transform": '{"kind": "free", "user": $lowercase($substringBefore(value, "@"))}'},
    {"id": "company", "when": '$contains(value, "@")', "transform": """(
        $host := $lowercase($split(value, "@")[-1]);
        $labels := $split($host, ".");
        $country := {"uk": "GB", "au": "AU"};
        $found := $lookup($country, $labels[-1]);
        {"kind": meta.kind, "host": $host, "depth": $count($labels), "country": $found ? $found : null, "short": $length($host) <= 12, "parts": $map($labels, function($l, $i) { $i = 0 ? $uppercase($l) : $l })}
    )"""},
    {"id": "other", "transform": '"not a mail: " & value'},
]})


@query(oracle("""SELECT id, CASE WHEN email IS NULL OR email = '' THEN '{"kind":"none","industry":"' || lower(industry) || '"}' WHEN email LIKE '%GMAIL.com' THEN '{"kind":"free","user":"' || lower(string_split(email, '@')[1]) || '"}'
    WHEN email LIKE '%@%' THEN '{"kind":"company","host":"' || h || '","depth":' || len(string_split(h, '.'))::VARCHAR || ',"country":' || CASE WHEN h LIKE '%.uk' THEN '"GB"' ELSE 'null' END
      || ',"short":' || (length(h) <= 12)::VARCHAR || ',"parts":["' || array_to_string([upper(string_split(h, '.')[1])] || string_split(h, '.')[2:], '","') || '"]}'
    ELSE 'not a mail: ' || email END AS email,
  CASE WHEN email IS NULL OR email = '' THEN 'none' WHEN email LIKE '%GMAIL.com' THEN 'free' WHEN email LIKE '%@%' THEN 'company' ELSE 'other' END AS rule
  FROM (SELECT *, lower(string_split(email, '@')[2]) AS h FROM companies)"""))
def expression_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression language on records: arrays, objects, lookups, functions in place, constants of the specification, other fields of the record."""
    new, rule = rules.cascade(MAILS)
    return companies(spark, sf_dir).select("id", new.alias("email"), rule.alias("rule"))


FIRST = "array_to_string(list_transform(string_split(lower(trim(regexp_replace(regexp_replace(name, ' Inc\\.$', ''), '\\s+', ' ', 'g'))), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


@query(oracle(f"""SELECT id, CASE grp % 2 WHEN 0 THEN regexp_replace(m, 'Works', 'WORKS') ELSE m END AS name, name AS name_before,
  CASE WHEN m <> name THEN 'company-name@1.2.0' || CASE WHEN grp % 2 = 0 THEN ',shout@1.0.0' ELSE '' END WHEN grp % 2 = 0 THEN 'shout@1.0.0' ELSE '' END AS applied
  FROM (SELECT *, CASE WHEN lower(name) LIKE '% inc.' OR name <> trim(regexp_replace(name, '\\s+', ' ', 'g')) THEN {FIRST} ELSE name END AS m FROM companies)"""))
def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specification in SQL, then one in the expression language on what the first made, and which of them changed the value."""
    shout = rules.checked({"id": "shout", "version": "1.0.0", "field": "name", "language": "jsonata", "rules": [{"id": "even", "when": "$number($match(value, /[0-9]+/).match) % 2 = 0", "transform": '$replace(value, /works/i, "WORKS")'}]})
    return rules.chain(companies(spark, sf_dir).select("id", "name"), [SPECS[0], shout], "name").select("id", "name", "name_before", F.array_join("applied", ",").alias("applied"))


# Sounds

#: Words and their two codes, as published or worked out by hand from the published rules.
WORDS = (
    ("Smith", "SM0", "XMT"), ("Schmidt", "XMT", "SMT"), ("Thumb", "0M", "TM"), ("Catherine", "K0RN", "KTRN"), ("Michael", "MKL", "MXL"), ("Knight", "NT", "NT"), ("Laugh", "LF", "LF"), ("Broughton", "PRTN", "PRTN"),
    ("Czerny", "SRN", "XRN"), ("Gallegos", "KLKS", "KKS"), ("Focaccia", "FKX", "FKX"), ("Chianti", "KNT", "KNT"), ("Wasserman", "ASRM", "FSRM"), ("Breaux", "PR", "PR"), ("Danger", "TNJR", "TNKR"), ("Schooner", "SKNR", "SKNR"), ("Xavier", "SF", "SFR"),
)
WORD_SQL = "(SELECT c_custkey, t.w AS word, t.a AS first, t.b AS second FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{w}', '{a}', '{b}')" for k, (w, a, b) in enumerate(WORDS)) + f") t(k, w, a, b) ON c_custkey % {len(WORDS)} = t.k)"


@query(f"SELECT c_custkey, word AS name, first, second FROM {WORD_SQL}")
def functions_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """double metaphone of names."""
    word = F.get(F.array(*(F.lit(w) for w, _, _ in WORDS)), (F.col("c_custkey") % len(WORDS)).cast("int"))
    named = table(spark, sf_dir, "customer").select("c_custkey", word.alias("name"))
    return named.select("c_custkey", "name", double_metaphone(F.col("name")).alias("s")).select("c_custkey", "name", "s.first", "s.second")


HEARD = (("Filips", "Phillips Group", "Phillips", "phonetic", 65), ("Katheryn", "Catherine Ltd.", "Catherine", "phonetic", 65), ("Nite", "Night Shop", "Knight", "phonetic", 65), ("Zyzzyx", None, None, "none", 0), ("Smyth", None, None, "none", 0))


@query("SELECT DISTINCT value, canonical, match_type, confidence FROM (SELECT concat(t.v, ' ', c_custkey) AS value, t.c AS canonical, t.m AS match_type, t.n AS confidence FROM customer JOIN (VALUES "
       + ", ".join(f"({k}, '{v}', {repr(c) if c else 'NULL'}, '{m}', {n})" for k, (v, c, _, m, n) in enumerate(HEARD)) + f") t(k, v, c, m, n) ON c_custkey % {len(HEARD)} = t.k)")
def lookup_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that only sound like an entry; an entry that takes no fuzzy matches (Smith) is not heard, the organisation's own entry beats the common one."""
    value = F.concat(F.get(F.array(*(F.lit(h[0]) for h in HEARD)), (F.col("c_custkey") % len(HEARD)).cast("int")), F.lit(" "), "c_custkey")
    rows = [(ref, canonical, None, True, True) for _, canonical, ref, _, _ in HEARD if ref] + [("Smith", "Smith & Co", None, True, False), ("Knight", "Common Knight", None, True, True)]
    rows = [(r, c, "o1" if r == "Knight" and c == "Night Shop" else o, a, e) for r, c, o, a, e in rows]
    reference = spark.createDataFrame(rows, "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    return lookup.lookup(table(spark, sf_dir, "customer").select(value.alias("value")), reference, org="o1", sounds=True)
