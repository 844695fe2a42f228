"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode one is made if it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tidewater-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where driver and executors share its folder.

    On a cluster without such a folder the package is sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Folders of this process's scratch tables.
_roots: list[str] = []


class Scratch:
    """Written Parquet tables: they cut the lineage and outlive lost executors.  ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tidewater/{label}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            _delete(self.spark, f"{self.root}/{name}".rstrip("/"))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove all scratch tables of this process.  DataFrames that read them must have been used or stored before."""
    while _roots:
        _delete(spark, _roots.pop())
