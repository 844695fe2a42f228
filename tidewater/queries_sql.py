"""Registered queries of SQL functions, numbering plans and relative dates, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import phone, text
from tidewater.plans import sql_functions
from tidewater.queries import FIRMS, KEYS, companies, firms, oracle, query, table


@query(oracle("""SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS clean, upper(name) AS loud, lower(trim(coalesce(email, ''))) AS mail,
  CASE trim(lower(state)) WHEN 'california' THEN 'CA' WHEN 'tx' THEN 'TX' WHEN 'ohio' THEN 'OH' WHEN 'fla.' THEN 'FL' ELSE state END AS state,
  CASE employees WHEN '1,200' THEN 1200.0 WHEN '50-100' THEN 50100.0 WHEN '$1.5M' THEN 1500000.0 WHEN ' 42 ' THEN 42.0 WHEN '2.5k' THEN 2500.0 END::DOUBLE AS staff,
  round(1 - levenshtein(lower(name), 'acme works 3')::DOUBLE / greatest(length(name), 12), 9) AS alike, len(list_distinct(list_filter(string_split(lower(regexp_replace(name, '[^A-Za-z ]', '', 'g')), ' '), lambda w: length(w) > 3 AND w <> 'inc'))) AS words FROM companies"""))
def sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.11: scalar functions in plain SQL; no Python worker starts."""
    sql_functions.register(spark)
    companies(spark, sf_dir).createOrReplaceTempView("tidy_companies")
    return spark.sql("""
        SELECT id, tidy_clean_whitespace(name) AS clean, tidy_normalize_case(name, 'UPPER') AS loud, tidy_email_lowercase(email) AS mail, tidy_state_abbreviate(state) AS state, tidy_parse_number(employees) AS staff,
          round(tidy_similarity(name, 'Acme works 3'), 9) AS alike, cast(size(filter(tidy_name_tokens(name), t -> t IN ('acme', 'works'))) AS bigint) AS words
        FROM tidy_companies""")


@query(oracle("SELECT id, kind, key FROM keys", FIRMS, KEYS))
def sql_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.11 and J7: a table function in SQL gives the blocking keys of each record."""
    sql_functions.register(spark)
    firms(spark, sf_dir).createOrReplaceTempView("tidy_firms")
    return spark.sql("SELECT id, k.kind, k.key FROM tidy_firms f, LATERAL tidy_company_keys(f.name, f.domain, f.phone, f.linkedin) k")


#: Country code, length of the national number and its usual groups, of the query below.
COUNTRIES = (("33", 9, (1, 2, 2, 2)), ("44", 10, (2, 4)), ("49", 11, (3, 3)), ("34", 9, (3, 2, 2)), ("48", 9, (3, 3)), ("41", 9, (2, 3, 2)), ("91", 10, (5,)), ("81", 10, (2, 4)), ("353", 9, (2, 3)), ("420", 9, (3, 3)), ("971", 9, (2, 3)), ("55", 11, (2, 5)), ("31", 9, (2, 3)))
NATIONAL = "concat('6', lpad(cast(c_custkey * 7919 % {} as string), {}, '0'))"


def _by_country(of) -> str:
    return "CASE " + " ".join(f"WHEN c_custkey % {len(COUNTRIES)} = {k} THEN {of(*c)}" for k, c in enumerate(COUNTRIES)) + " END"


def _national(code: str, length: int, groups: tuple[int, ...]) -> str:
    return NATIONAL.format(10 ** (length - 1), length - 1)


def _spaced(code: str, length: int, groups: tuple[int, ...]) -> str:
    cuts, at = [], 1
    for n in (*groups, length - sum(groups)):
        cuts.append(f"substr(n, {at}, {n})")
        at += n
    return f"'+{code} ' || " + " || ' ' || ".join(cuts)


@query(f"SELECT c_custkey, '+' || code || ' ' || n AS formatted, {_by_country(_spaced)} AS grouped FROM (SELECT c_custkey, {_by_country(lambda c, *_: repr(c))} AS code, {_by_country(_national)} AS n FROM customer)")
def functions_phone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbers of thirteen countries by their numbering plans, written as dialled at home where a trunk prefix is usual."""
    written = _by_country(lambda c, n, g: f"concat('+{c} {'(0) ' if phone.PLANS[c][1] == '0' else ''}', {_national(c, n, g)})")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{written} AS phone")
    return rows.select("c_custkey", phone.e164(F.col("phone"), "e164_formatted").alias("formatted"), phone.e164(F.col("phone"), "e164_grouped").alias("grouped"))


PHRASES = ("concat(cast(n as string), ' days ago')", "concat('in ', cast(n as string), ' weeks')", "'last month'", "'next Friday'", "concat(cast(n as string), ' months from now')", "'Yesterday'", "'tuesday'", "'March 5, 2024'", "'whenever'")
PHRASE = "CASE " + " ".join(f"WHEN c_custkey % {len(PHRASES)} = {k} THEN {p}" for k, p in enumerate(PHRASES)) + " END"


@query(f"""SELECT c_custkey, strftime(CASE c_custkey % {len(PHRASES)} WHEN 0 THEN t - to_days(n) WHEN 1 THEN t + to_days(7 * n) WHEN 2 THEN t - to_months(1) WHEN 3 THEN TIMESTAMP '2024-05-24 12:00:00' WHEN 4 THEN t + to_months(n) WHEN 5 THEN t - to_days(1)
  WHEN 6 THEN TIMESTAMP '2024-05-14 12:00:00' WHEN 7 THEN TIMESTAMP '2024-03-05 00:00:00' END, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM (SELECT c_custkey, (c_custkey % 40 + 1)::INT AS n, TIMESTAMP '2024-05-15 08:30:00' AS t FROM customer)""")
def functions_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrases against a given present, a Wednesday."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "cast(c_custkey % 40 + 1 as int) AS n").selectExpr("c_custkey", f"{PHRASE} AS phrase")
    return rows.select("c_custkey", text.parse_date(F.col("phrase"), "iso", F.lit(dt.datetime(2024, 5, 15, 8, 30))).alias("at"))
