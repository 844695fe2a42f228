"""Stratified samples, reproducible by a seeded hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater import values as V


def sample_size(total: int) -> int:
    """How many records a benchmark needs."""
    for most, n in ((50, total), (500, 50), (5_000, 100), (50_000, 200)):
        if total <= most:
            return n
    return 400


def stratified(records: DataFrame, stratum: str, id: str, n: int, seed: str = "tidewater") -> DataFrame:
    """n rows, strata in proportion and each at least one, in the order of a digest; short samples are filled from the largest strata."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id).cast("string")))
    sizes = records.groupBy(stratum).agg(F.count("*").alias("size"))
    every = F.sum("size").over(Window.partitionBy())
    quotas = sizes.withColumn("quota", F.greatest(F.lit(1.0), V.round_half_up(n * F.col("size") / every)))
    at = F.row_number().over(Window.partitionBy(stratum).orderBy("order", id))
    ranked = records.withColumn("order", order).withColumn("at", at).filter(F.col("at") <= n).join(F.broadcast(quotas) if quotas.count() <= 10_000 else quotas, stratum)
    first = ranked.withColumn("extra", (F.col("at") > F.col("quota")).cast("int"))
    return first.orderBy("extra", F.when(F.col("extra") == 1, -F.col("size")), stratum, "at").limit(n).drop("order", "at", "size", "quota", "extra")
