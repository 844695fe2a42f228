"""Sources and sinks: scans, CSV in and out, upserts, write-back plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import csv_safe
from tidewater.operators.resolve import latest_per_key

#: Life of cached rows in days, by kind of record.
TTL_DAYS = {"company": 30, "contact": 7}


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, since: tuple[str, object] | None = None) -> DataFrame:
    """Parquet scan with its columns and, if given, (column, instant): rows changed after it.  Both reach the reader."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter(F.col(since[0]) > F.lit(since[1]))
    return df.select(*columns) if columns else df


def by_ids(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records whose key is in a table of ids: point lookups, list members."""
    return records.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted CSV with a header; empty cells are null, rows of another width are dropped."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("nullValue", "").option("quote", '"').option("escape", '"').option("multiLine", True)
    return normalized_header((reader.schema(schema) if schema else reader).csv(path))


def read_csv_checked(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): quoted CSV with these columns as texts, empty cells null; rejected has the lines of another width as they are, which read_csv would drop unsaid."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_rejected"])
    reader = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").option("columnPruning", False).option("nullValue", "").option("quote", '"').option("escape", '"')
    rows = reader.csv(path)
    wrong = F.col("_rejected").isNotNull()
    return normalized_header(rows.filter(~wrong).drop("_rejected")), rows.filter(wrong).select(F.col("_rejected").alias("line"), F.col(columns[0]).alias("first"))


def normalized_header(df: DataFrame) -> DataFrame:
    """Header texts to property keys: lower case, words joined by _."""
    import re

    return df.toDF(*(re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns))


#: Kinds of columns by their header, and by the values that more than four fifths must look like.
KINDS = (("email", r"(?i)e-?mail", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), ("linkedin", r"(?i)linkedin", r"(?i)linkedin\.com/"), ("phone", r"(?i)phone|mobile", r"^[+(]?[0-9][0-9 ().\-]{6,}$"), ("domain", r"(?i)domain|website|url", r"(?i)^(https?://)?[a-z0-9-]+(\.[a-z0-9-]+)+"), ("name", r"(?i)name", None))


def column_kinds(df: DataFrame) -> dict[str, str]:
    """What each column of an import holds; one pass of counts."""
    import re

    counts = df.agg(*(F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").rlike(p).cast("double"))).alias(f"{i}:{kind}") for i, c in enumerate(df.columns) for kind, _, p in KINDS if p)).first()
    out = {}
    for i, c in enumerate(df.columns):
        out[c] = next((kind for kind, header, p in KINDS if re.search(header, c) or (p and (counts[f"{i}:{kind}"] or 0) > 0.8)), "text")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted and safe for spreadsheets."""
    safe = [csv_safe(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes]
    df.select(*safe).write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def upsert(current: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table after rows came in: the latest of each key."""
    return latest_per_key(current.unionByName(rows, allowMissingColumns=True), keys, at)


def live(cache: DataFrame, now, expires: str = "ttl_expires_at") -> DataFrame:
    return cache.filter(F.col(expires) > now)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """A layout from which readers skip partitions, such as weeks of usage."""
    df.write.mode("append").partitionBy(by).parquet(path)


def search(records: DataFrame, domain: str | None = None, name: str | None = None) -> DataFrame:
    """Records of a domain, or whose name has the words; the comparison with the domain reaches the reader."""
    if domain is not None:
        return records.filter(F.col("domain") == domain)
    return records.filter(F.lower("name").contains((name or "").lower()))


def write_gated(planned: DataFrame, path: str) -> None:
    """What a gate lets through, one folder an action (upsert, insert, review, skip); a rerun replaces the folders that it writes."""
    planned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("action").parquet(path)


def provider_table(spark: SparkSession, path: str, provider: str, columns: dict[str, str], id: str) -> DataFrame:
    """A provider's stored answers under our names, with its own name and the record's id; a live source would be a reader of the Python Data Source API."""
    rows = spark.read.parquet(path) if not path.endswith(".json") else spark.read.json(path)
    return rows.select(F.col(id).alias("record_id"), F.lit(provider).alias("provider"), *(F.col(c).alias(name) for c, name in columns.items()))


def demo_companies(spark: SparkSession, n: int = 10) -> DataFrame:
    """Made companies for a demonstration, the same each time, by rule."""
    k = F.col("k")
    return spark.range(n).withColumnRenamed("id", "k").select(
        F.format_string("demo-%03d", k).alias("id"), F.concat(F.lit("Demo Company "), k + 1).alias("name"), F.concat(F.lit("demo"), k + 1, F.lit(".example")).alias("domain"),
        (F.lit(10) * F.pow(F.lit(3), k % 6)).cast("int").alias("employee_count"), F.get(F.array(*map(F.lit, ("Software", "Retail", "Healthcare"))), (k % 3).cast("int")).alias("industry"),
        F.concat(F.lit("https://www.linkedin.com/company/demo-"), k + 1).alias("linkedin_url"),
    )


def demo_answers(companies: DataFrame, provider: str, fields: list[str], seed: int = 0) -> DataFrame:
    """Made answers of a provider for companies: about a quarter of the fields are missing, by a hash of provider, id and field."""
    gone = lambda f: F.pmod(F.xxhash64(F.lit(provider), "id", F.lit(f), F.lit(seed)), F.lit(4)) == 0
    return companies.select(F.col("id").alias("record_id"), *(F.when(~gone(f), F.col(f)).alias(f) for f in fields))
