"""The expression language, and rules that are written in it."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater import queries_rules
from tidewater.plans import expressions as X
from tidewater.plans import rules

SCHEMA = "value string, source string, city string, n string"


def run(spark, source, value="Ab cd", kind="string", **more):
    row = spark.createDataFrame([(value, "crm", "Oslo", "12")], SCHEMA if kind == "string" else SCHEMA.replace("value string", f"value {kind}"))
    node = X.compiled(source, F.col("value"), {"string": "string", "double": "number", "boolean": "boolean"}[kind], origin=F.col("source"), **more)
    fails = node.fails if node.fails is not None else F.lit(False)
    got, failed = row.select(X.result(node), fails).first()
    return "failed" if failed else got


CASES = [
    ("value", "x", "x"), ('"a" & "b" & value', "c", "abc"), ('"it\\u0027s\\n"', None, "it's\n"), ("1 + 2 * 3 - 4 / 2", None, "5"), ("-7 % 4", None, "-3"), ("(1 + 2) * 3", None, "9"), ("1 / 3 > 0.33", None, "true"),
    ("1 / 0", None, "failed"), ('"a" + 1', None, "failed"), ("value + 1", "2", "failed"), ("$number(value) + 1", "2.5", "3.5"), ("$number(value)", "2,5", "failed"), ("$number(value)", None, "failed"), ("$number(value)", "-3e2", "-300"),
    ("$uppercase(value)", None, "failed"), ("$uppercase(nowhere)", "x", None), ("value.inner", "x", None), ("$lowercase(value)", "ÀB", "àb"), ("$length(value)", "", "0"), ("$trim(value)", " a \n  b\t", "a b"),
    ("$substring(value, 1)", "abc", "bc"), ("$substring(value, -2)", "abc", "bc"), ("$substring(value, 1, 1)", "abc", "b"), ("$substring(value, -9, 2)", "abc", "ab"), ('$substringBefore(value, "@")', "a@b", "a"), ('$substringAfter(value, "@")', "a@b", "b"), ('$substringAfter(value, "#")', "a@b", "a@b"),
    ('$contains(value, "b.")', "ab.c", "true"), ("$contains(value, /^A/i)", "abc", "true"), ("$contains(value, /c$/)", "abc\n", "false"), ('$replace(value, ".", "-")', "a.b.c", "a-b-c"), ("$replace(value, /(a)(b)/, \"$2$1$$\")", "abab", "ba$ba$"), ('$replace(value, /\\//, "\\\\")', "a/b", "a\\b"),
    ('$split(value, ".")[1]', "a.b.c", "b"), ('$split(value, ".")[-1]', "a.b.c", "c"), ('$split(value, ".")[9]', "a.b.c", None), ("$split(value, /[ ,]+/)", "a, b c", '["a","b","c"]'), ('$count($split(value, ","))', "", "1"), ('$trim($split(value, ",")[1])', "a", None),
    ('$join($split(value, " "), "+")', "a b", "a+b"), ("$floor(2.7) & $ceil(2.1) & $abs(-3) & $round(2.5)", None, "2332"), ("$string(3.0) & $string(2.5) & $string(true)", None, "32.5true"), ("value & null", "x", "xnull"), ("value & nowhere", "x", "x"),
    ("value = null", None, "true"), ('value = "" or value = null', "", "true"), ("nowhere = null", "x", "false"), ("nowhere != 1", "x", "false"), ('value != "a"', None, "true"), ('value < "b"', "a", "true"), ("value < 3", "a", "failed"), ('value < "b"', None, "failed"), ("1 = 1.0", None, "true"), ('"1" = 1', None, "false"),
    ('value in ["a", "b"]', "b", "true"), ('value in ["a", "b"]', None, "false"), ('value in "b"', "b", "true"), ("value and $number(value) > 1", "", "false"), ("value or $number(value) > 1", "x", "true"), ("value and $number(value) > 1", "x", "failed"), ("$not(value)", "", "true"),
    ("value ? 1 : 2", "", "2"), ("value ? 1", "", None), ("value ? $number(value) : 0", "", "0"), ("value ? 1 : value = null ? 2 : 3", None, "2"), ("$exists(value)", None, "true"), ("$exists(nowhere)", None, "false"), ("$exists($match(value, /b/))", "abc", "true"), ("$exists($match(value, /x/))", "abc", "false"),
    ("$type(value)", "x", "string"), ("$type(value)", None, "null"), ("$type(1) & $type([1]) & $type({}) & $type(true)", None, "numberarrayobjectboolean"), ("$match(value, /(\\d+)-(\\d+)/).groups[1]", "a 12-34", "34"), ("$match(value, /[a-z]+/)", "12abc3", '{"match":"abc","index":2,"groups":[]}'), ("$match(value, /z/).groups[0]", "abc", None), ("$match(value, /z/).other", "zz", None),
    ('($a := value; $b := $a & "!"; $a := "z"; $b & $a)', "x", "x!z"), ('($x := 1; value ? ($x := 2; $x) : 0; $x)', "v", "1"), ('$map($split(value, " "), function($w, $i) { $i = 0 ? $uppercase($w) : $w })', "a b", '["A","b"]'), ('$map($split(value, " "), function($w) { $number($w) })', "1 x", "failed"),
    ('{"a": value, "b": null, "c": nowhere, "d": 1.5, "e": [1, 2], "f": {"g": true}}', 'q"\\', '{"a":"q\\"\\\\","b":null,"d":1.5,"e":[1,2],"f":{"g":true}}'), ('value ? {"a": 1} : {"b": "x"}', "", '{"b":"x"}'), ('value ? {"a": 1} : {"a": 2}', "", '{"a":2}'), ('(value ? {"a": 1} : {"a": 2}).a + 1', "", "3"), ('value ? {"a": 1} : null', "", None),
    ('$lookup({"x": "ex", "y": "why"}, value)', "y", "why"), ('$lookup({"x": "ex"}, value)', "y", None), ('$lookup({"x": {"z": 1}}, "x").z', None, "1"), ("source", None, "crm"), ("$source()", None, "crm"), ("record.city & record.n", None, "Oslo12"), ("$record().city", None, "Oslo"), ("meta.top & meta.n", None, "hi3"), ("/* a note */ value", "x", "x"),
    ('$coalesce(value, " ", record.city)', " ", "Oslo"), ('$normalize_case($clean_whitespace(value), "title")', " jean-paul  SARTRE ", "Jean-Paul Sartre"), ("$parse_number(value)", "$1.5M", "1500000"), ("$floor($parse_number(value))", "n/a", "failed"), ("$extract_domain(value)", "https://WWW.Acme.com/x", "acme.com"), ('$similarity(value, "helo")', "hello", "0.8"), ('$parse_date(value, "date")', "March 5, 2024", "2024-03-05"),
]


def test_results(spark):
    """All cases in one plan."""
    rows, cols = spark.createDataFrame([("crm", "Oslo", "12")], "source string, city string, n string"), []
    for k, (source, value, _) in enumerate(CASES):
        node = X.compiled(source, F.lit(value).cast("string"), origin=F.col("source"), meta={"top": "hi", "n": 3})
        fails = F.coalesce(node.fails, F.lit(False)) if node.fails is not None else F.lit(False)
        cols.append(F.when(fails, "failed").otherwise(X.result(node)).alias(f"c{k}"))
    got = list(rows.select(cols).first())
    assert [(s, v, g) for (s, v, w), g in zip(CASES, got) if g != w] == []


@pytest.mark.parametrize("kind,value,source,wanted", [("double", 2.0, "value", "2"), ("double", 2.5, "$type(value)", "number"), ("double", 2.0, "$lowercase(value)", "failed"), ("double", 2.0, '$type(value) = "string" and $contains(value, "x")', "false"), ("boolean", True, "value ? 1 : 0", "1"), ("boolean", False, "$string(value)", "false")])
def test_other_kinds(spark, kind, value, source, wanted):
    assert run(spark, source, value, kind) == wanted


@pytest.mark.parametrize("source,named", [
    ("value ~> $uppercase", "~>"), ("$sort(value)", "$sort"), ("value[$ > 1]", "$"), ("$", "$ for the input"), ("value.*", "'*'"), ("value^(x)", "^"), ("[1..3]", ".."), ("1 +", "too early"), ("(value", "')'"), ("value value", "unexpected"), ("$replace(value, /a/, value)", "constant"), ("$match(value, record.n)", "regular"),
    ("3 := 4", "assigned"), ('["a", 1]', "several kinds"), ('value["x"]', "filter"), ("$length(value, 1, 2)", "$length"), ("{value: 1}", "plain text"), ("$contains(value, /a/x)", "flags"), ("`", "unexpected"), ("($a := value & value; " + "$a := $a & $a; " * 20 + "$a)", "unfolds"),
])
def test_what_is_not_supported_is_named(spark, source, named):
    with pytest.raises(X.ExpressionError) as error:
        X.compiled(source, F.col("value"))
    assert named in str(error.value) and error.value.code == "compile_error"


SPEC = {"id": "s", "version": "1", "field": "value", "language": "jsonata", "rules": [{"id": "first", "when": "$number(value) > 5", "transform": '"big"'}, {"id": "second", "when": "value", "transform": "$number($trim(value))", "default": "none"}]}


@pytest.mark.parametrize("mode,value,wanted", [
    ("fail_silent", "9", ("big", "first")), ("fail_silent", " 3 ", ("3", "second")), ("fail_silent", "x", ("x", None)), ("fail_silent", None, (None, None)), ("fail_default", "x", ("none", "second")), ("fail_default", "9", ("big", "first")), ("fail_loud", "9", ("big", "first")),
])
def test_error_policies(spark, mode, value, wanted):
    rows = spark.createDataFrame([(value,)], "value string")
    assert tuple(rows.select(*rules.cascade({**SPEC, "on_error": mode})).first()) == wanted


def test_fail_loud_raises(spark):
    with pytest.raises(Exception, match="s/first: no result for x"):
        spark.createDataFrame([("x",)], "value string").select(*rules.cascade({**SPEC, "on_error": "fail_loud"})).collect()


def test_null_is_a_result(spark):
    spec = {"id": "s", "version": "1", "field": "value", "language": "jsonata", "rules": [{"id": "blank", "when": 'value = ""', "transform": "null"}, {"id": "rest", "transform": '"rest"'}]}
    rows = spark.createDataFrame([("",), ("a",), (None,)], "value string")
    assert [tuple(r) for r in rows.select(*rules.cascade(spec)).collect()] == [(None, "blank"), ("rest", "rest"), ("rest", "rest")]


def test_sources_and_library_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("""
id: shout
version: 2.0.0
applies_to: {fields: [company.name], entity: company}
sources: [crm]
on_error: fail-silent-log
rules:
  - {id: none, when: value = null, transform: "null"}
  - {id: up, transform: '{"name": $uppercase(value), "n": $length(value)}'}
tests:
  - {name: a, input: ab, expected: {name: AB, n: 2}}
  - {name: b, input: null, expected: null}
  - {name: wrong, input: ab, expected: {name: AB, n: 3}}
""")
    spec = rules.load(str(tmp_path))["shout"]
    assert (spec["field"], spec["language"], spec["on_error"], spec["entity"]) == ("name", "jsonata", "fail_silent", "company")
    assert [c["name"] for c in rules.run_tests(spark, spec)] == ["wrong"]
    rows = spark.createDataFrame([("a", "crm"), ("b", "web"), ("c", None)], "name string, source string")
    assert [r[0] for r in rows.select(rules.cascade(spec)[0]).collect()] == ['{"name":"A","n":1}', "b", "c"]
    with pytest.raises(X.ExpressionError, match="shout/up"):
        rules.checked({**spec, "rules": [{"id": "up", "transform": "value ~> $f"}]})


def test_specifications_of_the_queries_hold_their_own_cases(spark):
    assert rules.run_tests(spark, queries_rules.AMOUNTS) == []
    assert json.loads(run(spark, queries_rules.MAILS["rules"][2]["transform"], "a@B.uk", meta={"kind": "k"})) == {"kind": "k", "host": "b.uk", "depth": 2, "country": "GB", "short": True, "parts": ["B", "uk"]}


def test_no_python_worker(spark, sf, capsys):
    for name in ("expression_amounts", "expression_objects"):
        getattr(queries_rules, name)(spark, sf).explain("formatted")
        assert "Python" not in capsys.readouterr().out
