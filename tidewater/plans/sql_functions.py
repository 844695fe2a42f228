"""The library's functions in SQL: temporary functions made from the same Columns as the Python ones.

``register`` defines scalar functions and table functions of the session, each
an expression of built-in functions, so that a query in SQL is planned and
compiled as a whole and starts no Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import casing, names, phone, records, similarity, text
from tidewater.operators import dedup

PREFIX = "tidy_"
#: Operators that the text of a Column has in front of their arguments, as functions are written.
OPERATORS = {"=", "!=", "<>", "<=>", "<", "<=", ">", ">=", "!", "+", "-", "*", "/", "%", "&", "|", "^", "~", "and", "or", "not", "in", "like", "rlike", "div", "between"}
TOKEN = re.compile(r"'(?:\\.|[^'\\])*'|`[^`]*`|->|<=>|[!<>=]=|<>|[A-Za-z_]\w*|\d[\w.]*|\s+|.", re.S)


def _styled(make: Callable[[Column, str], Column], *styles: str) -> Callable[[Column, Column], Column]:
    """A function whose style is an argument: one case for each, the first for all others."""

    def of(c: Column, style: Column) -> Column:
        out = None
        for s in styles[1:]:
            out = F.when(F.lower(style) == s, make(c, s)) if out is None else out.when(F.lower(style) == s, make(c, s))
        return out.otherwise(make(c, styles[0]))

    return of


#: Scalar functions: names and types of the arguments, and the Column.
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "clean_whitespace": ("s string", text.clean_whitespace), "normalize_case": ("s string, style string", _styled(text.normalize_case, "lower", "upper", "title", "sentence")), "parse_number": ("s string", text.parse_number),
    "format_phone": ("s string, region string", _styled(phone.format_phone, "international", "us", "uk")), "extract_domain": ("s string", text.extract_domain), "first_filled": ("a string, b string, c string", text.first_filled),
    "similarity": ("a string, b string", similarity.similarity), "trigram_similarity": ("a string, b string", similarity.trigram_similarity), "jaro_winkler": ("a string, b string", similarity.jaro_winkler),
    "parse_date": ("s string, now timestamp", lambda s, now: text.parse_date(s, "iso", now)), "e164": ("s string", phone.e164), "email_lowercase": ("s string", text.email_lowercase), "linkedin_url": ("s string", text.linkedin_url),
    "smart_title_case": ("s string", casing.smart_title_case), "numeric_parse": ("s string", text.numeric_parse), "url_canonical": ("s string", text.url_canonical), "employee_range": ("s string", text.employee_range), "domain_format": ("s string", text.domain_format),
    "state_abbreviate": ("s string", text.state_abbreviate), "country_code": ("s string", text.country_code), "job_level": ("s string", names.job_level), "job_role": ("s string", names.role), "job_seniority": ("s string", names.seniority),
    "company_name": ("s string", names.normalize_company_name), "email_label": ("s string", names.email_label), "employee_band": ("n bigint", names.employee_band), "revenue_band": ("n double", names.revenue_band),
    "csv_safe": ("s string", text.csv_safe), "name_tokens": ("s string", names.name_tokens), "is_e164": ("s string", phone.is_e164), "clean_domain": ("s string", records.clean_domain),
}
#: Table functions: arguments, and an array of structs or of single values whose elements are the rows.
TABLES: dict[str, tuple[str, Callable[..., Column], str]] = {
    "company_keys": ("name string, domain string, phone string, linkedin string", dedup.company_keys, "kind string, key string"),
    "contact_keys": ("email string, phone string, linkedin string", dedup.contact_keys, "kind string, key string"),
    "name_token_rows": ("s string", lambda s: F.transform(names.name_tokens(s), lambda t: F.struct(t.alias("token"))), "token string"),
}


def written(column: Column) -> str:
    """A Column as SQL that can be parsed: operators before brackets become quoted function names."""
    out, tokens = [], TOKEN.findall(column._jc.node().sql())
    for k, token in enumerate(tokens):
        after = tokens[k + 1] if k + 1 < len(tokens) else ""
        out.append(f"`{token}`" if after == "(" and token.lower() in OPERATORS else token)
    return "".join(out)


def _arguments(listed: str) -> list[tuple[str, str]]:
    return [tuple(a.split()) for a in listed.split(", ")]


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Define all functions of this module for the session; their names.  What was defined under a name before is replaced."""
    made = []
    for name, (listed, build) in SCALARS.items():
        given = [(f"arg_{a}", kind) for a, kind in _arguments(listed)]
        body = build(*(F.col(a) for a, _ in given))
        result = spark.createDataFrame([], ", ".join(f"{a} {k}" for a, k in given)).select(body).schema[0].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(f'{a} {k}' for a, k in given)}) RETURNS {result} RETURN {written(body)}")
        made.append(prefix + name)
    for name, (listed, build, rows) in TABLES.items():
        given = [(f"arg_{a}", kind) for a, kind in _arguments(listed)]
        columns = ", ".join(f"row.{a} AS {a}" for a, _ in _arguments(rows))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(f'{a} {k}' for a, k in given)}) RETURNS TABLE({rows}) RETURN SELECT {columns} FROM (SELECT explode({written(build(*(F.col(a) for a, _ in given)))}) AS row)")
        made.append(prefix + name)
    return made
