"""Provider sources: pushed filters, pulls that are stopped and gone on with; keyed state with timers."""

import datetime as dt
import json

import pytest

from tidewater.plans import predicates
from tidewater.sources import provider
from tidewater.streaming import clusters

COLUMNS = {"name": "their_name", "size": "n", "score": "x", "at": "t"}
SCHEMA = "record_id string, provider string, name string, size int, score double, at timestamp, missing string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("answers"))
    rows = [(k, [None, "", "Ab", "ab c", "Zoë", "zz"][k % 6], [None, 1, 5, 2**40][k % 4] if k % 4 != 3 else 7, float("nan") if k % 5 == 0 else k / 2, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), "unused") for k in range(300)]
    df = spark.createDataFrame(rows, "id bigint, their_name string, n bigint, x double, t timestamp, other string")
    df.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1024).parquet(f"{path}/in")
    return f"{path}/in"


def scan(spark, path, tree=None):
    return provider.answers(spark, path, "p", "id", COLUMNS, SCHEMA, tree)


def plain(spark, path):
    return spark.read.parquet(path).selectExpr("cast(id as string) record_id", "'p' provider", "their_name name", "cast(n as int) size", "x score", "t at", "cast(null as string) missing")


def rows(df):
    return sorted(map(repr, df.collect()))


FILTERS = ["size = 5", "size > 1 AND name = 'Ab'", "name IN ('ab c', 'Zoë', NULL)", "name IS NULL AND size >= 1", "name LIKE 'a%'", "name LIKE '%b%' OR size = 7", "score > 10", "score = 'NaN'", "at > TIMESTAMP '2024-01-05'", "record_id = '7'", "record_id > '5'", "provider = 'p'", "provider = 'q'", "missing IS NULL", "NOT (size = 5)", "name <=> NULL", "size < 100 AND size <= 7 AND score IS NOT NULL"]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters_give_the_same_rows(spark, stored, condition):
    assert rows(scan(spark, stored).filter(condition)) == rows(plain(spark, stored).filter(condition))


def leaf(field, kind, operator, value=None):
    return {"field": field, "fieldType": kind, "operator": operator, "value": value}


@pytest.mark.parametrize("groups,match", [
    ([[leaf("name", "string", "equals", "AB")]], "any"), ([[leaf("name", "string", "equals", "")]], "any"), ([[leaf("name", "string", "contains", "B"), leaf("size", "number", "gte", 5)], [leaf("name", "string", "starts_with", "ZO")]], "any"),
    ([[leaf("name", "string", "not_equals", "ab")], [leaf("size", "number", "lt", 3)]], "all"), ([[leaf("name", "enumeration", "is_any_of", ["AB", "zz"])]], "all"), ([[leaf("name", "string", "is_not_empty")]], "all"), ([[leaf("missing", "string", "equals", "x")]], "any"), ([[leaf("score", "number", "gt", 20)]], "any"), ([], "all"),
])
def test_condition_trees_give_the_same_rows(spark, stored, groups, match):
    tree = {"match": match, "groups": [{"match": "all", "conditions": g} for g in groups]}
    assert rows(scan(spark, stored, tree)) == rows(plain(spark, stored).filter(predicates.compile_tree(tree)))


def test_plan_shows_what_is_pushed_and_what_is_applied_again(spark, stored, capsys):
    df = scan(spark, stored, {"match": "all", "groups": [{"match": "all", "conditions": [leaf("name", "string", "equals", "ab c")]}]}).filter("size > 2 AND score > 1")
    df.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThan(size,2)" in pushed and "score" not in pushed.replace("IsNotNull(score)", "")
    assert "score" in next(line for line in plan.splitlines() if line.startswith("Condition")) and "lower" in plan


def test_row_groups_are_partitions_and_some_are_skipped(spark, stored):
    numbered = provider.answers(spark, stored, "p", "id", COLUMNS, SCHEMA.replace("record_id string", "record_id bigint"))
    some, none = numbered.filter("record_id < 50"), numbered.filter("record_id > 1000")
    assert numbered.rdd.getNumPartitions() == 3 and some.rdd.getNumPartitions() == none.rdd.getNumPartitions() == 1
    assert some.count() == 50 and none.count() == 0


def test_stopped_pull_goes_on(spark, stored, tmp_path):
    how = {"chunk": 70, "schema": SCHEMA}
    whole = provider.pull(spark, stored, "p", "id", COLUMNS, f"{tmp_path}/a", **how)
    parts = provider.pull(spark, stored, "p", "id", COLUMNS, f"{tmp_path}/b", most=2, **how)
    seen = parts.count()
    assert 140 <= seen <= 300
    parts = provider.pull(spark, stored, "p", "id", COLUMNS, f"{tmp_path}/b", **how)
    assert rows(parts) == rows(whole) == rows(plain(spark, stored))
    mark = json.loads((tmp_path / "b/generation=1/mark.json").read_text())
    assert mark["planned"] == 300 and mark["done"] <= 300
    spark.createDataFrame([(900, "new", 1, 0.5, dt.datetime(2025, 1, 1), "")], "id bigint, their_name string, n bigint, x double, t timestamp, other string").coalesce(1).write.parquet(f"{tmp_path}/more")
    both = tmp_path / "both"
    both.mkdir()
    for k, f in enumerate([*sorted(__import__("pathlib").Path(stored).glob("*.parquet")), *(tmp_path / "more").glob("*.parquet")]):
        (both / f"{k}.parquet").write_bytes(f.read_bytes())
    first = provider.pull(spark, str(both), "p", "id", COLUMNS, f"{tmp_path}/c", chunk=1000, schema=SCHEMA, mode="full")
    again = provider.pull(spark, str(both), "p", "id", COLUMNS, f"{tmp_path}/c", chunk=1000, schema=SCHEMA)
    renewed = provider.pull(spark, str(both), "p", "id", COLUMNS, f"{tmp_path}/c", chunk=1000, schema=SCHEMA, mode="full")
    assert first.count() == again.count() == renewed.count() == 301
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["generation=1", "generation=2"]


EVENTS = "event bigint, cluster string, kind string, member string, other string, ts timestamp"


def test_taken_in_members_can_be_restored_until_they_expire(spark, tmp_path):
    day = lambda d, k=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=k)
    batches = [
        [(1, "a", "merge", "m", "x", day(0)), (2, "b", "deletion", "m", None, day(0)), (3, "c", "merge", "m", "y", day(0)), (4, None, "merge", "m", "y", day(0)), (5, "c", "change", "m", None, day(0))],
        [(6, "a", "restore", "x", None, day(2)), (7, "a", "merge", "m", "z", day(2, 1)), (8, "b", "merge", "m", "q", day(2)), (9, "c", "deletion", "m", None, day(2)), (10, "c", "restore", "nobody", None, day(2))],
        [(11, "d", "merge", "m", "x", day(20))],
        [(12, "c", "restore", "y", None, day(21)), (13, "a", "deletion", "z", None, day(21))],
    ]
    for k, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    query = clusters.tracked(stream, window_days=5).writeStream.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    status = {c: max((v, s) for _, x, s, v, _, _ in seen if x == c) for c in "abcd"}
    assert status == {"a": (3, "merged"), "b": (1, "invalid"), "c": (1, "merged"), "d": (1, "merged")}
    gone = {c: h for _, c, _, _, h, why in seen if why == "expired"}
    assert gone["a"] == 0 and gone["c"] == 0  # nothing is left to restore once the watermark has passed
    assert status["c"][1] == "merged"  # its restore came too late


def test_updates_of_one_key_type(spark, tmp_path):
    data = [(7, "merge", dt.datetime(2024, 1, 2)), (7, "deletion", dt.datetime(2024, 1, 1)), (8, "other", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(data, "k int, handler string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream, seen = spark.readStream.schema("k int, handler string, ts timestamp").parquet(f"{tmp_path}/in"), []
    query = clusters.last_effects(stream, "k", "handler", "ts", {"merge": "merged", "deletion": "invalid"}).writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert seen == [(7, "merged", 2)]


def test_batch_fold_is_the_same_as_the_stream():
    held = {}
    taken = type("T", (), {"get": lambda s, m: held.get(m), "put": lambda s, m, at: held.update({m: at})})()
    c = clusters.Cluster(10)
    for kind, member, other, at in (("merge", "m", "x", 0), ("deletion", "m", None, 1), ("restore", "x", None, 10), ("merge", "m", "x", 11), ("restore", "x", None, 22)):
        c.take(kind, member, other, at, taken)
    assert (c.status, c.version, held) == ("merged", 3, {"x": 11})
