"""Event streams: repeats and late events out, routing, state of clusters, increments.

All transformations take a streaming or a static DataFrame, so that a replay in
batch gives the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.resolve import latest_per_key

from . import clusters

STALE = "5 minutes"
#: What a kind of event makes of the cluster that holds its record.
EFFECTS = {"deletion": "invalid", "merge": "merged", "restore": "reopened"}


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as a stream, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark; instants without a zone are taken in the session's."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def once(events: DataFrame, keys: list[str], at: str = "ts", late: str = STALE) -> DataFrame:
    """Each event once; repeats are known as long as the watermark has not passed them."""
    if events.isStreaming:
        return _timed(events, at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def fresh(events: DataFrame, received: Column, at: str = "ts", late: str = STALE) -> DataFrame:
    """Events received within the time limit after they were signed."""
    return events.filter(F.col(at) >= received - F.expr(f"INTERVAL {late}"))


def routed(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """The handler of each event: deletion, merge, restore, change or creation."""
    k = F.lower(F.col(kind))
    return events.withColumn("handler", F.when(k.contains("delet"), "deletion").when(k.contains("merge"), "merge").when(k.contains("restor"), "restore").when(k.contains("change"), "change").otherwise("creation"))


def with_records(events: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Stream-static join: events with what is known of their record."""
    return events.join(records, key, "left")


def windowed(events: DataFrame, at: str = "ts", width: str = "1 hour", slide: str | None = None, by: str = "event_type", late: str = STALE) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; an extension beyond the rest of this library's operators."""
    e = _timed(events, at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    g = e.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = STALE) -> DataFrame:
    e = _timed(events, at, late)
    g = e.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def lifecycle(events: DataFrame, key: str, kind: str = "handler", at: str = "ts") -> DataFrame:
    """State of each record's cluster after its events so far, as updates: (key, status, version).

    Streams keep one small state for each key; a batch folds the same order
    into the last state.
    """
    if events.isStreaming:
        return clusters.last_effects(events, key, kind, at, EFFECTS)
    states = events.filter(F.col(kind).isin(*EFFECTS))
    names = F.create_map(*(F.lit(x) for pair in EFFECTS.items() for x in pair))
    return states.groupBy(key).agg(F.max_by(names[F.col(kind)], F.struct(at, kind)).alias("status"), F.count("*").cast("int").alias("version"))


def upsert_sink(path: str, keys: list[str], at: str):
    """A foreachBatch function: each batch's latest rows by key as a new generation beside the last."""
    def write(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, keys, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there and stop; a rerun goes on behind it."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def scan_mode(last_full: dt.datetime | None, last_scan: dt.datetime | None, now: dt.datetime, forced: bool = False, undated: int = 0) -> str:
    """Full if forced, the first, more than a week after the last full one, or if records have no date; else incremental."""
    if forced or last_full is None or last_scan is None or undated or now - last_full > dt.timedelta(days=7):
        return "full"
    return "incremental"


def changed_since(records: DataFrame, at: str, mark) -> tuple[DataFrame, object]:
    """Records behind the high-water mark, and the new mark."""
    rows = records if mark is None else records.filter(F.col(at) > F.lit(mark))
    new = rows.agg(F.max(at)).first()[0]
    return rows, new if new is not None else mark
