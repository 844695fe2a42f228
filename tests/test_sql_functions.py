"""Functions in SQL against the Columns that they are made from."""

import pytest
from pyspark.sql import functions as F

from tidewater.plans import sql_functions as S

VALUES = [None, "", " Ab  cd ", "ACME-works / north", "$1.5M", "(2.5k)", "https://www.Acme.co.uk/x?y", "+44 (0) 20 7946 0958", "1 (310) 387-9598", "x.y@mail.acme.co.uk", "linkedin.com/in/Jo-Do?x", "California", "uk", "Chief Revenue Officer", "it's a \\ test'", "=1+1", "last month", "Zoë & Söhne GmbH, Inc."]


@pytest.fixture(scope="module")
def rows(spark):
    S.register(spark)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "k int, v string")
    df.createOrReplaceTempView("sql_values")
    return df


@pytest.mark.parametrize("name", sorted(S.SCALARS))
def test_scalar_is_its_column(spark, rows, name):
    listed, build = S.SCALARS[name]
    kinds = [k for _, k in S._arguments(listed)]
    sample = {"string": "v", "timestamp": "timestamp'2024-05-15 08:00:00'", "bigint": "cast(k * 100 as bigint)", "double": "cast(k * 1e6 as double)"}
    second = {"normalize_case": "'Title'", "format_phone": "'UK'"}.get(name, "reverse(v)")
    args = [sample[kinds[0]], *(second if k == "string" else sample[k] for k in kinds[1:])]
    got = spark.sql(f"SELECT k, tidy_{name}({', '.join(args)}) AS r FROM sql_values")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.select("k", build(*map(F.expr, args)).alias("r")).collect()))


def test_table_functions(spark, rows):
    got = spark.sql("SELECT k, t.token FROM sql_values, LATERAL tidy_name_token_rows(v) t")
    want = rows.select("k", F.explode(S.SCALARS["name_tokens"][1](F.col("v"))).alias("token"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    keys = spark.sql("SELECT * FROM tidy_contact_keys('A@b.c ', '310 387 9598', NULL)").collect()
    assert sorted(map(tuple, keys)) == [("email", "a@b.c"), ("phone", "310387")]


def test_no_python_worker(spark, rows, capsys):
    spark.sql("SELECT tidy_e164(v), tidy_smart_title_case(v), tidy_jaro_winkler(v, reverse(v)), size(tidy_name_tokens(v)) FROM (SELECT cast(id AS string) AS v FROM range(9))").explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Eval" not in plan and "codegen id" in plan
