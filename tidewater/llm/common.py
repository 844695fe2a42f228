"""What the operators share: words, intermediate tables, joins with a checked broadcast."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.storage import Scratch, shared_folder

__all__ = ["Scratch", "importable", "join_dimension", "n_words", "py_words", "row_key", "shared_folder", "spare"]

#: White space of all contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: For Python: str.translate table that turns the five controls into spaces.
TO_SPACE = {ord(c): " " for c in SPACES}

#: A dimension of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def py_words(text: str) -> list[str]:
    """Words of a text in Python, the same as WORD_CLASS+ finds."""
    return [w for w in text.translate(TO_SPACE).split(" ") if w]


def n_words(text: Column) -> Column:
    """Number of words (bigint); null counts as 0.  Split parts less the empty ones at both ends."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("bigint")


def row_key(id: str, text: str) -> Column:
    """128 bits that tell rows apart by id and text; rows alike have the same."""
    return F.struct(F.xxhash64(id, text).alias("a"), F.xxhash64(F.lit(1), text, id).alias("b"))


def spare(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where driver and executors share its folder.

    On a cluster without such a folder the package is sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def join_dimension(facts: DataFrame, dim: DataFrame, key: str, rows: int, how: str = "left", salts: int = 64) -> DataFrame:
    """Null-safe join of facts to a dimension with one row per key.

    Up to BROADCAST_ROWS (``rows`` is the counted size) the dimension is
    broadcast.  A larger one is copied ``salts`` times and joined on key and
    salt, so that a key with a third of all facts is spread over as many tasks.
    """
    named, salt, fsalt = (spare(x, [*facts.columns, *dim.columns]) for x in ("key", "salt", "fsalt"))
    d = dim.withColumnRenamed(key, named)
    if rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(d), facts[key].eqNullSafe(d[named]), how).drop(named)
    d = d.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    f = facts.withColumn(fsalt, F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    return f.join(d, f[key].eqNullSafe(d[named]) & (f[fsalt] == d[salt]), how).drop(named, salt, fsalt)
