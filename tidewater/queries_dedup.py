"""Registered queries of stored blocking keys, growing clusters and near names, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.operators import components, dedup
from tidewater.operators.dedup_index import KeyIndex
from tidewater.operators.near_text import near_texts
from tidewater.queries import FIRMS, KEYS, PAIRS, SCORES, WALK, _company_keys, _scored, companies, firms, oracle, query
from tidewater.storage import Scratch, shared_folder


@query(oracle("SELECT a, b FROM pairs WHERE substr(a, 2)::BIGINT % 50 = 0 OR substr(b, 2)::BIGINT % 50 = 0", FIRMS, KEYS, PAIRS))
def dedup_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index stored before some records changed, refreshed by these alone, gives the pairs that a full scan has for them."""
    c = firms(spark, sf_dir)
    late = F.substring("id", 2, 9).cast("bigint") % 50 == 0
    before = c.withColumn("domain", F.when(late, F.concat(F.lit("before"), "grp", F.lit(".com"))).otherwise(F.col("domain"))).withColumn("name", F.when(late, F.lit("Old name")).otherwise(F.col("name")))
    gone = before.limit(1).select(F.lit("c999999999").alias("id"), F.col("name"), "domain", "phone", "linkedin")
    index = KeyIndex.create(spark, f"{shared_folder(spark)}/tidewater/index-{uuid.uuid4().hex}", before.select("id", "name", "domain", "phone", "linkedin").unionByName(gone).select("id", _company_keys().alias("keys")), buckets=16)
    changed = c.filter(late)
    index.refresh(changed.select("id", _company_keys().alias("keys")), removed=gone.select("id"))
    return KeyIndex(spark, index.root).candidates(changed.select("id"))


@query(oracle("SELECT id, cluster FROM roots", FIRMS, KEYS, PAIRS, SCORES, WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def clusters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of half of the pairs, into which the other half is merged; only clusters that it joins are written anew."""
    scratch = Scratch(spark, "merged")
    edges = scratch.write(_scored(spark, sf_dir, 65).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), "edges")
    half = F.pmod(F.crc32(F.concat("u", "v")), F.lit(2))
    known = scratch.write(components.labels(edges.filter(half == 0), Scratch(spark, "merged-old")), "known")
    return components.merged(known, edges.filter(half == 1), scratch)[0].select(F.col("node").alias("id"), F.col("root").alias("cluster"))


@query(oracle("SELECT id, cluster FROM kept_roots", FIRMS, KEYS, PAIRS, SCORES, WALK, """kept AS (SELECT a, b FROM scored WHERE confidence >= 65 AND substr(a, 2)::BIGINT % 7 <> 0),
  two AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept), reach AS (SELECT a AS id, a AS seen FROM two UNION SELECT reach.id, two.b FROM reach JOIN two ON two.a = reach.seen),
  kept_roots AS (SELECT id, min(seen) AS cluster FROM reach GROUP BY id)""").replace("WITH ", "WITH RECURSIVE ", 1))
def clusters_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of some records went away; only the clusters that held them are found anew."""
    scratch = Scratch(spark, "split")
    edges = scratch.write(_scored(spark, sf_dir, 65).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), "edges")
    known = scratch.write(components.labels(edges, Scratch(spark, "split-old")), "known")
    lost = F.substring("u", 2, 9).cast("bigint") % 7 == 0
    touched = edges.filter(lost).select("u").unionByName(edges.filter(lost).select(F.col("v").alias("u")))
    return components.recomputed(known, edges.filter(~lost), touched, scratch)[0].select(F.col("node").alias("id"), F.col("root").alias("cluster"))


PLAIN = "plain AS (SELECT left(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 4) AS block, lower(trim(name)) AS t, min(id) AS id FROM companies GROUP BY ALL)"


@query(oracle("SELECT a.id AS a, b.id AS b, round(1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)), 9) AS similarity FROM plain a JOIN plain b ON a.block = b.block AND a.id < b.id WHERE 1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)) >= 0.85 - 1e-12", PLAIN))
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7's name key where it is crowded: all names begin alike and make one block; of them only pairs with an edit similarity of 0.85 come out, found without meeting all others."""
    c = companies(spark, sf_dir)
    letters = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    rows = c.select("id", F.lower(F.trim("name")).alias("text"), F.left(letters, F.lit(4)).alias("block"))
    return near_texts(rows, 0.85, block="block")[1].withColumn("similarity", V.round_half_up(F.col("similarity"), 9))


@query(oracle("SELECT DISTINCT cluster, TIMESTAMP '2024-05-01 06:00:00' AS scheduled_at FROM roots JOIN scored ON a = id WHERE confidence >= 98 AND substr(cluster, 2)::BIGINT % 2 = 0 AND substr(cluster, 2)::BIGINT % 4 <> 0 AND cluster IN (SELECT r.cluster FROM roots r JOIN scored s ON s.a = r.id WHERE s.grade = 'A')", FIRMS, KEYS, PAIRS, SCORES, WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def merge_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and pending clusters of grade A with a sure pair, and when they are due."""
    pairs = _scored(spark, sf_dir, 65)
    number = F.substring("cluster", 2, 9).cast("bigint")
    found = dedup.clusters(pairs).withColumn("status", F.when(number % 4 == 0, "merged").otherwise("pending"))
    due = dedup.auto_merge(found, pairs, 0.98, new=found.filter(number % 2 == 0).select("cluster"), now=F.lit("2024-04-30 06:00:00").cast("timestamp"), hours=24)
    return due.select("cluster", "scheduled_at")


@query(oracle("SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y ON x.kind = y.kind AND x.key = y.key AND x.id < y.id WHERE NOT (x.kind = 'domain' AND (x.key = 'gmail.com' OR x.key LIKE '%0.com'))", FIRMS, KEYS.replace("FROM firms) WHERE h <> ''", "FROM (SELECT * REPLACE (CASE WHEN grp % 15 = 0 THEN 'https://www.Gmail.com' ELSE domain END AS domain) FROM firms)) WHERE h <> ''")))
def excluded_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of mail providers and of an organisation's own list block nothing."""
    c = firms(spark, sf_dir).withColumn("domain", F.when(F.col("grp") % 15 == 0, "https://www.Gmail.com").otherwise(F.col("domain")))
    listed = c.select(F.regexp_extract("domain", r"(?i)(company\d*0\.com)(/|$)", 1).alias("domain")).filter("domain <> ''").withColumn("domain", F.concat(F.lit("http://"), "domain"))
    return dedup.pairs_of(dedup.without_excluded(c, _company_keys(), listed))
