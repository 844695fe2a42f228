"""Registered queries of provider sources, pulls and keyed state on streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.queries import query, table
from tidewater.sources import provider
from tidewater.storage import shared_folder
from tidewater.streaming import clusters

CUSTOMER = {"name": "c_name", "industry": "c_mktsegment", "nation": "c_nationkey", "balance": "c_acctbal"}
TREE = {"match": "any", "groups": [
    {"match": "all", "conditions": [{"field": "industry", "fieldType": "string", "operator": "equals", "value": "building"}, {"field": "nation", "fieldType": "number", "operator": "lt", "value": 9}]},
    {"match": "all", "conditions": [{"field": "industry", "fieldType": "enumeration", "operator": "is_any_of", "value": ["Machinery"]}, {"field": "name", "fieldType": "string", "operator": "ends_with", "value": "7"}]},
]}


@query("SELECT c_custkey AS record_id, 'ledger' AS provider, c_name AS name, c_mktsegment AS industry, c_nationkey AS nation, c_acctbal AS balance FROM customer WHERE ((c_mktsegment = 'BUILDING' AND c_nationkey < 9) OR (c_mktsegment = 'MACHINERY' AND c_name LIKE '%7')) AND c_nationkey > 2 AND c_acctbal > 0")
def provider_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's answers by a condition tree, of which it evaluates what it can; further comparisons are pushed by the optimizer, what it does not take is applied again."""
    schema = "record_id bigint, provider string, name string, industry string, nation int, balance double"
    return provider.answers(spark, f"{sf_dir}/customer.parquet", "ledger", "c_custkey", CUSTOMER, schema, TREE).filter("nation > 2 AND balance > 0")


@query("SELECT o_orderkey AS record_id, 'shop' AS provider, o_orderstatus AS status, o_totalprice AS price FROM orders")
def provider_pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers pulled in chunks, stopped after two of them and gone on with behind the stored mark; each row comes once."""
    folder, path = f"{shared_folder(spark)}/tidewater/pull-{uuid.uuid4().hex}", f"{sf_dir}/orders.parquet"
    chunk = spark.read.parquet(path).count() // 5 + 1
    how = {"chunk": chunk, "schema": "record_id bigint, provider string, status string, price double"}
    provider.pull(spark, path, "shop", "o_orderkey", {"status": "o_orderstatus", "price": "o_totalprice"}, folder, most=2, **how)
    return provider.pull(spark, path, "shop", "o_orderkey", {"status": "o_orderstatus", "price": "o_totalprice"}, folder, **how)


KIND = "CASE event_id % 7 WHEN 0 THEN 'deletion' WHEN 1 THEN 'merge' WHEN 2 THEN 'merge' WHEN 3 THEN 'restore' WHEN 4 THEN 'restore' WHEN 5 THEN 'restore' ELSE 'change' END"
WINDOW = "INTERVAL 5 DAYS"


def _restored(m: int) -> str:
    return f"(e.kind = 'restore' AND e.member = {m} AND s.a{m} IS NOT NULL AND e.ts - s.a{m} <= {WINDOW})"


_STATUS = "CASE WHEN e.kind = 'deletion' AND s.status <> 'merged' THEN 'invalid' WHEN e.kind = 'merge' AND s.status = 'open' THEN 'merged' WHEN " + " OR ".join(map(_restored, range(4))) + " THEN 'open' ELSE s.status END"


@query(f"""WITH RECURSIVE e AS (
  SELECT user_id AS cluster, date_trunc('milliseconds', ts) AS ts, {KIND} AS kind, event_id // 7 % 4 AS member, (event_id // 7 + 1) % 4 AS other, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('milliseconds', ts), event_id) AS n
  FROM events WHERE event_id % 7 < 6),
s AS (
  SELECT DISTINCT cluster, 0::BIGINT AS n, 'open' AS status, 0 AS version, {', '.join(f'NULL::TIMESTAMP AS a{m}' for m in range(4))} FROM e
  UNION ALL
  SELECT s.cluster, e.n, {_STATUS}, s.version + ({_STATUS} <> s.status)::INT, {', '.join(f"CASE WHEN e.kind = 'merge' AND s.status = 'open' AND e.other = {m} THEN e.ts ELSE s.a{m} END" for m in range(4))}
  FROM s JOIN e ON e.cluster = s.cluster AND e.n = s.n + 1)
SELECT cluster::VARCHAR AS cluster, arg_max(status, n) AS status, max(version)::INT AS version FROM s GROUP BY cluster""")
def clusters_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events pulled in chunks through keyed state with timers; what a merge took in can be restored for five days."""
    root = f"{shared_folder(spark)}/tidewater/life-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", f"{KIND} AS kind", "event_id div 7 % 4 AS member", "(event_id div 7 + 1) % 4 AS other")
    e.repartitionByRange(8, "ts").sortWithinPartitions("ts", "event_id").write.parquet(f"{root}/in")
    columns = {"event": "event_id", "cluster": "user_id", "ts": "ts", "kind": "kind", "member": "member", "other": "other"}
    schema = "record_id bigint, provider string, event bigint, cluster bigint, ts timestamp, kind string, member bigint, other bigint"
    stream = provider.pulled(spark, f"{root}/in", "webhooks", "event_id", columns, f"{root}/mark.json", e.count() // 4 + 1, schema)
    provider.run_chunks(clusters.tracked(stream, window_days=5), f"{root}/out", f"{root}/checkpoint")
    return clusters.latest(spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out"))
