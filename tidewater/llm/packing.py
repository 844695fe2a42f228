"""Best-fit packing of documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open, a bitset keyed
by free space finds the fullest bin in which a piece fits, and when a bin more
is needed the fullest closes first.  Documents are tokenized once, where they
lie; only the pieces' lengths move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, importable, spare
from .tokens import documents_ids, vocabulary

#: Pieces that one task packs: enough to leave few bins open, few enough for many tasks.
GROUP = 40_000
OPEN_BINS = 1024


class Packer:
    """Open bins by free space: bit f of ``mask`` is set if a bin has f places left."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.mask, self.open, self.made = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            space, bin_ = self.capacity, self.made
            self.made += 1
        if space > length:
            self.free.setdefault(space - length, []).append(bin_)
            self.mask |= 1 << (space - length)
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.free[space]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << space)
        self.open -= 1
        return found


def pieces(docs: DataFrame, capacity: int, path: str, end: int, id: str, text: str) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.  Only documents above the capacity are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, documents_ids(path, batch.column(1).to_pylist(), end)):
                raw = memoryview(ids.astype("<u4")).cast("B")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - lo)
                    rows.append((key, k, lo, n, zlib.crc32(raw[4 * lo : 4 * (lo + n)])))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=[id, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(cut, f"`{id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, capacity: int = 4096, open_bins: int = OPEN_BINS, group: int = GROUP, path: str | None = None, end: int = 1,
         id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with the sequence it goes to and its offset there.

    Null text is an empty document: the end id alone.  Rows alike are packed
    each for itself.  Pieces reach the groups by a hash of their place in the
    stored pieces, so no key can fill one group, and the order of arrival, that
    of the hash, does not depend on lengths.  An empty table gives no pieces.
    Other columns are dropped.
    """
    spark = docs.sparkSession
    importable(spark)
    made = Scratch(spark, "packing").write(pieces(docs, capacity, path or vocabulary(), end, id, text), "pieces")
    groups = max(1, -(-made.count() // group))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, Packer] = {}
        for batch in batches:
            where = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if g not in packers:
                    packers[g] = Packer(capacity, open_bins)
                bin_, offset = packers[g].put(n)
                where.append((g << 32 | bin_, offset))
            columns = np.array(where, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(columns[:, 0]), pa.array(columns[:, 1])], names=[*batch.schema.names[1:], "sequence_id", "offset"])

    kind = docs.schema[id].dataType.simpleString()
    h, g = spare("h", made.columns), spare("g", made.columns)
    shuffled = made.withColumn(h, F.xxhash64(id, "piece", "ids_crc32", F.monotonically_increasing_id())).withColumn(g, F.pmod(h, F.lit(groups)))
    return (
        shuffled.repartition(groups, g).sortWithinPartitions(g, h).select(g, id, "piece", "start", "length", "ids_crc32")
        .mapInArrow(place, f"`{id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    )
