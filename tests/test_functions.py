import pytest
from pyspark.sql import functions as F

from tidewater.functions import names, phone, similarity, text
from tidewater.plans import predicates


def each(spark, made, values):
    rows = [(k, v) for k, v in enumerate(values)]
    got = spark.createDataFrame(rows, "n int, v string").select("n", made(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(got, key=lambda r: r["n"])]


CASES = [
    (text.parse_number, ["$1.5M", "15,000", "2.5B", "$500K", "(300)", "-4", "10-20", "abc", "", None, "€ 3T", "12abc"], [1.5e6, 15000.0, 2.5e9, 5e5, -300.0, -4.0, 1020.0, None, None, None, 3e12, 12.0]),
    (text.numeric_parse, ["10-20", "1-2", "$1.5M", "1,234.5", "100k employees", "7"], ["15", "2", "1500000", "1235", None, "7"]),
    (lambda c: text.normalize_case(c, "title"), ["ACME CORP", "acme corporation", "jean-luc o/b", "", None], ["Acme Corp", "Acme Corporation", "Jean-Luc O/B", "", None]),
    (lambda c: text.normalize_case(c, "sentence"), ["hELLO World", ""], ["Hello world", ""]),
    (text.clean_whitespace, ["  a \t b\n", None, "﻿x"], ["a b", None, "x"]),
    (text.extract_domain, ["https://www.Acme.com/x", "acme.co.uk", "http://a.b:8080/", "", None, "WWW.x.org"], ["acme.com", "acme.co.uk", "a.b", None, None, "x.org"]),
    (text.linkedin_url, ["http://linkedin.com/company/acme/?x=1", "https://de.linkedin.com/in/Jo-Do", "x.com"], ["https://www.linkedin.com/company/acme", "https://www.linkedin.com/in/Jo-Do", None]),
    (text.url_canonical, ["Acme.com", "https://A.com/Path?x=1", "not a url"], ["https://acme.com/", "https://a.com/Path?x=1", None]),
    (text.employee_range, ["1", "9", "1,200", "many", "10001", ""], ["1", "2-10", "1001-5000", "many", "10001+", ""]),
    (text.state_abbreviate, ["california", "ny", "Bavaria", "Tex."], ["CA", "NY", "Bavaria", "TX"]),
    (text.country_code, ["uk", "UK", "fr", "United States", "Narnia"], ["GB", "GB", "FR", "US", "Narnia"]),
    (lambda c: text.parse_date(c, "date"), ["2024-03-05", "March 5, 2024", "3/5/2024", "5 Mar 2024", "soon"], ["2024-03-05"] * 4 + [None]),
    (text.csv_safe, ["=1+1", "ok", "@x"], ["'=1+1", "ok", "'@x"]),
    (phone.format_phone, ["(310) 387-9598", "13103879598", "12345", "", None], ["+1 (310) 387-9598", "+1 (310) 387-9598", "+1 12345", None, None]),
    (lambda c: phone.format_phone(c, "UK"), ["+44 20 7946 0018", "020 7946 0018", "0123456789"], ["+44 20 7946 0018", "+44 20 7946 0018", "+44 12 345 6789"]),
    (phone.e164, ["1 (310) 387-9598", "310-387-9598", "+44 20 7010 2000", "911", "1-800-FLOWERS", "(310) 387-9598 x123", "+123456789012345678"], ["+13103879598", "+13103879598", "+442070102000", None, "+18003569377", "+13103879598", None]),
    (lambda c: phone.e164(c, "e164_spaces"), ["+44 20 7010 2000", "+61 2 9374 4000", "310-387-9598", "+49 30 1234567"], ["+44 20 7010 2000", "+61 2 9374 4000", "+1 310 387 9598", "+49 301 234 567"]),
    (names.normalize_company_name, ["Acme Solutions, Inc.", "  ACME  llc ", None], ["acme", "acme", ""]),
    (names.clean_last_name, ["Smith, MBA", "Doe PhD", "Jones - CDMP®", "Lee"], ["Smith", "Doe", "Jones", "Lee"]),
    (names.email_label, ["x@northwind.com", "x@example.co.uk", "x@mail.acme.com", "nobody", "a@b@c.de", None], ["northwind", "example", "acme", "", "", ""]),
    (names.job_level, ["Chief of Staff", "VP Sales", "Head of Ops", "Sales Manager", "Engineer", "", "Senior Vice President", "Assistant to the VP", "Chief Clinical Officer", "President", "Business Analyst", "Analyst, Senior", "Board Certified Behavior Analyst", "Principal Engineer Lead"], ["IC", "VP", "Director", "Manager", "IC", "Other", "EVP / SVP", "IC", "C-Suite", "Founder", "Needs Review", "IC", "IC", "Manager"]),
    (names.string_hash, ["hello", "", "the quick brown fox"], [99162322, 0, None]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    made, given, want = CASES[case]
    got = each(spark, made, given)
    for g, w in zip(got, want):
        if made is not names.string_hash or w is not None:
            assert g == w


def test_string_hash_wraps(spark):
    def brute(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c) + 2**31) % 2**32 - 2**31
        return h

    words = ["the quick brown fox jumps", "z" * 40, "a"]
    assert each(spark, names.string_hash, words) == [brute(w) for w in words]


def test_full_names(spark):
    got = each(spark, names.split_full_name, ["Jane van Doe, MBA", "Solo", ""])
    assert [(r["first"], r["last"]) for r in got] == [("Jane", "van Doe"), ("Solo", ""), ("", "")]


def test_similarities(spark):
    pairs = [("hello", "helo"), ("northwind", "north wind"), ("apple", "microsoft"), (None, "x"), ("", ""), ("Same", "same")]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "n int, a string, b string").orderBy("n")
    got = rows.select(similarity.similarity(F.col("a"), F.col("b")).alias("e"), similarity.jaro_winkler(F.col("a"), F.col("b")).alias("j"), similarity.trigram_similarity(F.col("a"), F.col("b")).alias("t")).collect()
    assert got[0]["e"] == pytest.approx(0.8) and got[1]["j"] > 0.85 and got[2]["j"] < 0.5 and got[3]["e"] == 0 and got[5]["e"] == 1 and got[5]["t"] == 1


def test_trigrams(spark):
    assert sorted(each(spark, similarity.trigrams, ["Cat dog"])[0]) == ["  c", "  d", " ca", " do", "at ", "cat", "dog", "og "]


def test_name_tokens(spark):
    assert each(spark, names.name_tokens, ["Acme & Sons Group"])[0] == ["acme", "acme & sons", "acme & sons group", "acme sons", "as", "sons"]


def test_pattern_and_first_filled(spark):
    r = each(spark, lambda c: text.match_pattern(c, r"(\d+)-(\w+)", 2), ["x 12-ab", "none", None])
    assert (r[0]["matched"], r[0]["groups"], r[0]["fullMatch"]) == (True, ["12", "ab"], "12-ab") and not r[1]["matched"] and not r[2]["matched"]


@pytest.mark.parametrize("tree,want", [
    (None, True), ({"match": "all", "groups": []}, True), ({"match": "any", "groups": []}, False), ({"match": "all", "groups": [{"match": "any", "conditions": []}]}, False),
    ({"match": "all", "groups": [{"match": "all", "conditions": [{"field": "v", "fieldType": "number", "operator": "lt", "value": 5}]}]}, False),
])
def test_empty_trees_and_blank_numbers(spark, tree, want):
    row = spark.createDataFrame([(None,)], "v string").select(predicates.compile_tree(tree).alias("x")).first()
    assert row["x"] is want


def test_blank_number_can_be_zero(spark):
    leaf = predicates.leaf({"field": "v", "fieldType": "number", "operator": "lt", "value": 5}, blank_is_zero=True)
    assert [r["x"] for r in spark.createDataFrame([("",), ("x",), ("3",)], "v string").select(leaf.alias("x")).collect()] == [True, False, True]


def test_suppression_scopes(spark):
    row = spark.createDataFrame([(("a", None), ("A", "x"))], "a struct<f:string,g:string>, b struct<f:string,g:string>")
    got = row.select(predicates.suppression("f", "matches_between").alias("m"), predicates.suppression("g", "is_blank", scope="both").alias("both"), predicates.suppression("g", "is_blank", scope="either").alias("either"), predicates.suppression("g", "differs_between").alias("d")).first()
    assert (got["m"], got["both"], got["either"], got["d"]) == (True, False, True, True)


def test_filters_for_a_source_and_columns_that_rules_need():
    from tidewater.plans import flows, predicates

    native = {"equals": "EQ", "contains": "HAS"}
    leaf = lambda op, f="name": {"field": f, "fieldType": "string", "operator": op, "value": "x"}
    tree = lambda match, *groups: {"match": match, "groups": [{"match": m, "conditions": list(cs)} for m, *cs in groups]}
    eq, has = ("name", "EQ", "x"), ("name", "HAS", "x")
    assert flows.source_filters(tree("any", ("all", leaf("equals"), leaf("contains"))), native) == ([[eq, has]], False)
    assert flows.source_filters(tree("any", ("all", leaf("equals"), leaf("is_empty"))), native) == ([[eq]], True)
    assert flows.source_filters(tree("any", ("any", leaf("equals"), leaf("contains"))), native) == ([[eq], [has]], False)
    assert flows.source_filters(tree("any", ("any", leaf("equals"), leaf("is_empty"))), native) == ([], True)
    assert flows.source_filters(tree("all", ("all", leaf("equals")), ("all", leaf("contains"))), native) == ([[eq, has]], False)
    assert flows.source_filters(None, native) == ([], True)
    assert predicates.condition_count(tree("all", ("all", leaf("equals")), ("any", leaf("contains"), leaf("equals")))) == 3
    spec = {"field": "name", "rules": [{"when": "`state` = 'x'", "transform": "upper($value)"}, {"format": "email_lowercase"}]}
    assert flows.required_columns([spec, {**spec, "field": "email"}]) == ["id", "name", "state", "email"]
