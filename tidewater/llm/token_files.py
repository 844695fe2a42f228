"""Token ids of a corpus as entropy-coded binary frames, and reading them back.

The file format, one Parquet row per frame (Parquet is only the container that
Spark can write to and read from any store in parallel):

shard, frame    place in doc_id order
start           ids of the shard before this frame
doc_ids         the documents of the frame, in order; lengths: ids of each
block           ids in a block; the last block of a frame may hold fewer
states          checkpoint of each block: its STATES 64-bit coder states (little-endian)
words           32-bit words of each block, so its place in the payload
crc32           checksum of each block's ids (little-endian 32-bit)
payload         the blocks' 32-bit words, block after block

Ids are coded with a static range asymmetric numeral system.  One frequency
table, counted over all documents and scaled to 2**SCALE, is shared by all
frames and stored beside them.  A block is coded by STATES interleaved states,
id after id in turn, which share one stream of words.  Each block is
independent, so any is decoded without the others; numpy steps through all blocks of a frame at
once, one lane for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, importable, join_dimension, spare
from .tokens import documents_ids, vocabulary

SCALE = 20
LOWEST = 1 << 31
BLOCK = 1024
STATES = 4
#: Ids that a frame gathers before it is written; a document is never parted.
FRAME = 1 << 21
#: Coded ids of one shard at about two bytes an id.
SHARD_IDS = 6_000_000

FRAMES = ("shard int, frame int, start bigint, n_tokens bigint, doc_ids array<{kind}>, lengths binary, block int, states binary, words binary, crc32 binary, payload binary")


class Table:
    """Scaled frequencies of the ids that occur, and the slots to find an id by."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.int64), freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        self.rank[self.ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids), dtype=np.int32), freq)


def scaled(ids: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2**scale, each at least 1, near in proportion to the counts."""
    if len(ids) > 1 << scale:
        raise ValueError("more different ids than slots")
    freq = np.maximum(1, np.floor(counts / counts.sum() * (1 << scale))).astype(np.int64)
    over = int(freq.sum()) - (1 << scale)
    if over <= 0:
        freq[np.argmax(counts)] -= over
        return freq
    for k in np.argsort(-freq, kind="stable"):  # raised ones are paid for by the most frequent
        cut = min(over, int(freq[k]) // 2)
        freq[k] -= cut
        over -= cut
        if not over:
            return freq
    return freq


def encode(ids: np.ndarray, table: Table, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (a row a block), number of words per block, and all words."""
    lanes = -(-len(ids) // block)
    padded = np.full(lanes * block, table.ids[np.argmax(table.freq)])
    padded[: len(ids)] = ids
    rank = table.rank[padded].reshape(lanes, block).T
    states = np.full((STATES, lanes), LOWEST, np.uint64)
    words, put = np.zeros((block, lanes), np.uint32), np.zeros((block, lanes), bool)
    shift, low, top = np.uint64(SCALE), np.uint64(32), np.uint64((LOWEST >> SCALE) << 32)
    for t in range(block - 1, -1, -1):
        freq, own = table.freq[rank[t]], states[t % STATES]
        full = own >= top * freq
        words[t], put[t] = own.astype(np.uint32), full
        own = np.where(full, own >> low, own)
        whole = own // freq
        states[t % STATES] = (whole << shift) + (own - whole * freq) + table.first[rank[t]]
    return np.ascontiguousarray(states.T), put.sum(0).astype(np.uint32), words.T[put.T]


def decode(n: int, states: np.ndarray, words: np.ndarray, payload: np.ndarray, table: Table, block: int = BLOCK) -> np.ndarray:
    """The n ids of consecutive blocks from their checkpoints and words."""
    states = np.array(states.reshape(-1, STATES).T, order="C")
    at = np.cumsum(words, dtype=np.int64) - words
    payload = np.append(payload, np.uint32(0)).astype(np.uint64)
    out = np.zeros((block, states.shape[1]), np.int64)
    shift, low, slot = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
    for t in range(block):
        own = states[t % STATES]
        s = own & slot
        rank = table.slots[s]
        out[t] = rank
        own = table.freq[rank] * (own >> shift) + s - table.first[rank]
        more = own < LOWEST
        states[t % STATES] = np.where(more, own << low | payload[np.minimum(at, len(payload) - 1)], own)
        at += more
    return table.ids[out.T.ravel()[:n]]


def _frame(shard: int, number: int, start: int, keys: list, each: list[np.ndarray], table: Table) -> dict:
    ids = np.concatenate(each)
    states, words, payload = encode(ids, table)
    raw = ids.astype("<u4").tobytes()
    crcs = [zlib.crc32(raw[4 * lo : 4 * (lo + BLOCK)]) for lo in range(0, len(ids), BLOCK)]
    return {
        "shard": shard, "frame": number, "start": start, "n_tokens": len(ids), "doc_ids": keys, "lengths": np.array(list(map(len, each)), "<i8").tobytes(), "block": BLOCK,
        "states": states.astype("<u8").tobytes(), "words": words.astype("<u4").tobytes(), "crc32": np.array(crcs, "<u4").tobytes(), "payload": payload.astype("<u4").tobytes(),
    }


def read_frame(row: dict, table: Table) -> Iterator[tuple[object, int, np.ndarray]]:
    """(doc id, ids of the shard before it, its ids) of a frame; a wrong checksum raises."""
    ids = decode(row["n_tokens"], np.frombuffer(row["states"], "<u8"), np.frombuffer(row["words"], "<u4"), np.frombuffer(row["payload"], "<u4"), table, row["block"])
    raw = ids.astype("<u4").tobytes()
    step = 4 * row["block"]
    if [zlib.crc32(raw[lo : lo + step]) for lo in range(0, len(raw), step)] != np.frombuffer(row["crc32"], "<u4").tolist():
        raise ValueError(f"shard {row['shard']}, frame {row['frame']}: wrong checksum")
    ends = np.cumsum(np.frombuffer(row["lengths"], "<i8"))
    for key, a, b in zip(row["doc_ids"], np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        yield key, row["start"] + a, ids[a:b]


def write_files(docs: DataFrame, scratch: Scratch, path: str | None = None, end: int = 1, id: str = "doc_id", text: str = "text") -> None:
    """Write the frames and the frequency table of all documents below the scratch folder."""
    importable(docs.sparkSession)
    path, kind = path or vocabulary(), docs.schema[id].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\xff" + x.astype("<u4").tobytes() for x in documents_ids(path, batch.column(1).to_pylist(), end)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary())], names=[id, "ids"])

    def ids_of(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            flat = np.concatenate([np.zeros(0, np.int64), *(ids_of(x) for x in batch.column(0).to_pylist())]).astype(np.int64)
            n = np.bincount(flat, minlength=len(total))
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    made = scratch.write(docs.select(id, text).mapInArrow(tokenize, f"`{id}` {kind}, ids binary"), "ids")
    counts = made.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # no more rows than the vocabulary has ids
    ids, n = np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    freq = scaled(ids, n) if len(ids) else n
    scratch.write(docs.sparkSession.createDataFrame(list(zip(ids.tolist(), freq.tolist())), "id bigint, freq bigint").coalesce(1), "table")
    table = docs.sparkSession.sparkContext.broadcast((ids, freq))
    shards = max(1, -(-int(n.sum()) // SHARD_IDS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), Table(*table.value)
        keys, each, size, number, start, schema = [], [], 0, 0, 0, None
        for batch in batches:
            schema = schema or _arrow_frames(batch.schema.field(0).type)
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                each.append(ids_of(raw))
                size += len(each[-1])
                if size >= FRAME:
                    yield pa.RecordBatch.from_pylist([_frame(shard, number, start, keys, each, own)], schema)
                    keys, each, number, start, size = [], [], number + 1, start + size, 0
        if keys:
            yield pa.RecordBatch.from_pylist([_frame(shard, number, start, keys, each, own)], schema)

    tie, row = spare("tie", made.columns), spare("row", made.columns)
    ordered = made.withColumn(tie, F.xxhash64("ids")).withColumn(row, F.monotonically_increasing_id())
    keys = [F.col(id).asc_nulls_first(), F.col(tie), F.col(row)]
    ordered = ordered.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select(id, "ids")
    scratch.write(ordered.mapInArrow(code, FRAMES.format(kind=kind)), "frames")
    scratch.drop("ids")


def _arrow_frames(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(kind)), ("lengths", pa.binary()), ("block", pa.int32()), *((c, pa.binary()) for c in ("states", "words", "crc32", "payload"))])


def read_files(spark: SparkSession, root: str, id: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32.  Only the frequency table, no larger than the vocabulary, reaches the driver."""
    scratch = Scratch(spark, "reading")
    importable(spark)
    frames = spark.read.parquet(f"{root}/frames")
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()
    stored = spark.read.parquet(f"{root}/table").collect()
    table = spark.sparkContext.broadcast((np.array([r["id"] for r in stored], np.int64), np.array([r["freq"] for r in stored], np.int64)))
    starts = scratch.write(shard_starts(frames), "starts")
    placed = join_dimension(frames, starts, "shard", starts.count(), "inner")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*table.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                rows = [(key, row["before"] + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, a, ids in read_frame(row, own)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_ids").type.value_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[id, "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(scan, f"`{id}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_starts(frames: DataFrame, stretch: int = 1000) -> DataFrame:
    """(shard, before): ids of all shards before each, by sums over stretches of shards and inside each; at most one row a stretch meets in one task."""
    sums = frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("at", F.floor(F.col("shard") / stretch))
    inside = F.sum("n").over(Window.partitionBy("at").orderBy("shard")) - F.col("n")
    stretches = sums.groupBy("at").agg(F.sum("n").alias("all"))
    stretches = stretches.select(F.col("at").alias("to"), (F.sum("all").over(Window.orderBy("at")) - F.col("all")).alias("upto"))
    own = sums.withColumn("inside", inside)
    return own.join(stretches, own["at"] == stretches["to"]).select("shard", (F.col("inside") + F.col("upto")).alias("before"))


def tokenize_and_read(docs: DataFrame, path: str | None = None, end: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a corpus in doc_id order, nulls first, and return what its files say of each document.

    A null text is an empty one: the end id alone.  Rows with one id follow
    each other by a hash of their ids, then by place in the input.  An empty
    table gives no frames and no rows.  Other columns are dropped.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    write_files(docs, scratch, path, end, id, text)
    return read_files(docs.sparkSession, scratch.root, id)
