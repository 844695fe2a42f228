"""A stored index of blocking keys: scans of changed records read the buckets that these touch, and no others.

Two tables lie in buckets by a hash: ``keys`` (kind, key, id) by kind and key,
``records`` (id, keys) by id, which says what a record's keys were.  A refresh
writes the touched buckets as a new generation and a manifest that names the
generation of each bucket; readers of the old manifest are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.storage import Scratch

KEYS = "array<struct<kind:string,key:string>>"


class KeyIndex:
    """``buckets`` is fixed when an index is created; about a hundred thousand rows to a bucket serve well."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.number = max(self._listed("manifest"), default=-1)
        held = spark.read.parquet(f"{self.root}/manifest/generation={self.number}").collect() if self.number >= 0 else []  # one row a bucket of either table
        self.at = {(r["part"], r["bucket"]): r["written"] for r in held}
        self.buckets = held[0]["buckets"] if held else 0
        self.kind = held[0]["id_type"] if held else "string"

    @classmethod
    def create(cls, spark: SparkSession, root: str, keyed: DataFrame, buckets: int = 64) -> KeyIndex:
        """An index of all records, (id, keys); whatever lay there is superseded."""
        index = cls(spark, root)
        index.at, index.buckets, index.kind = {}, buckets, keyed.schema["id"].dataType.simpleString()
        rows = index._made(keyed)
        index._publish({"keys": (index._entries(rows), range(buckets)), "records": (rows, range(buckets))})
        return index

    def keys(self, buckets: list[int] | None = None) -> DataFrame:
        """(kind, key, id) of some buckets, or of all."""
        return self._read("keys", f"kind string, key string, id {self.kind}", buckets)

    def records(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read("records", f"id {self.kind}, keys {KEYS}", buckets)

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Take in what changed records, (id, keys), look like now, and forget removed ids; how many buckets of each table were written."""
        rows = self._made(changed)
        ids = rows.select("id") if removed is None else rows.select("id").unionByName(removed.select(F.col(removed.columns[0]).alias("id")))
        ids = ids.distinct()
        homes = self._touched(ids.select(self._home("id").alias("b")))
        before = self.records(homes)
        places = self._touched(self._entries(before.join(ids, "id", "left_semi")).unionByName(self._entries(rows)).select(self._place().alias("b")))
        self._publish({
            "keys": (self.keys(places).join(ids, "id", "left_anti").select("kind", "key", "id").unionByName(self._entries(rows)), places),
            "records": (before.join(ids, "id", "left_anti").unionByName(rows), homes),
        })
        return {"keys": len(places), "records": len(homes)}

    def candidates(self, changed: DataFrame) -> DataFrame:
        """Distinct pairs (a, b), a < b, that share a key and of which one is a changed id; only buckets with a key of these are read."""
        ids = changed.select(F.col(changed.columns[0]).alias("id")).distinct()
        own = self.records(self._touched(ids.select(self._home("id").alias("b")))).join(ids, "id", "left_semi")
        mine = self._entries(own)
        places = self._touched(mine.select(self._place().alias("b")))
        met = mine.withColumnRenamed("id", "x").join(self.keys(places).withColumnRenamed("id", "y"), ["kind", "key"]).filter("x <> y")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def _made(self, keyed: DataFrame) -> DataFrame:
        """Records and their keys, stored: both tables and the buckets are told from them, and keys are dear to make."""
        return Scratch(self.spark, "index-rows").write(keyed.select("id", F.col("keys").cast(KEYS).alias("keys")), "rows")

    def _entries(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode("keys").alias("k")).select("k.kind", "k.key", "id").distinct()

    def _place(self) -> Column:
        return F.pmod(F.xxhash64("kind", "key"), F.lit(self.buckets)).cast("int")

    def _home(self, id: str) -> Column:
        return F.pmod(F.xxhash64(id), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.distinct().collect())  # at most one row a bucket

    def _read(self, part: str, schema: str, buckets: list[int] | None) -> DataFrame:
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.root}/{part}/generation={self.at[part, b]}/bucket={b}" for b in wanted if (part, b) in self.at]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, parts: dict[str, tuple[DataFrame, object]]) -> None:
        number, at = self.number + 1, dict(self.at)
        for part, (rows, buckets) in parts.items():
            folder = f"{self.root}/{part}/generation={number}"
            order = ("kind", "key", "id") if part == "keys" else ("id",)
            placed = rows.withColumn("bucket", self._place() if part == "keys" else self._home("id"))
            placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(folder)
            for b in buckets:
                at.pop((part, b), None)
            at.update({(part, b): number for b in self._listed(f"{part}/generation={number}", "bucket=")})
        listed = [(part, b, g, self.buckets, self.kind) for (part, b), g in sorted(at.items())] or [("none", -1, -1, self.buckets, self.kind)]
        self.spark.createDataFrame(listed, "part string, bucket int, written int, buckets int, id_type string").coalesce(1).write.parquet(f"{self.root}/manifest/generation={number}")
        self.number, self.at = number, at

    def _listed(self, folder: str, prefix: str = "generation=") -> list[int]:
        """Numbers of the complete subfolders; a manifest without its mark of success was never published."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith(prefix)]
        if folder == "manifest":
            success = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            found = [p for p in found if system.exists(success(p, "_SUCCESS"))]
        return [int(p.getName().split("=")[1]) for p in found]
