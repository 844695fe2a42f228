"""Hard negatives: near rows of another label, by bit-sliced integer products.

Components are integers; a block of rows stores them as bit planes, most
significant (the sign) first.  The product of an anchor with a row is built
plane by plane.  What the planes to come can still add lies between the sums
of the anchor's negative and of its positive components, times the largest
number that the remaining bits can make, so each plane tightens the interval of
the product; a pair is dropped once its interval cannot qualify.  First the
planes meet all rows of a tile by one matrix product each; when few pairs are
left, only those go on.

Rows are dealt into blocks by a hash, and the anchors, a stated query set,
visit every block; so rows move once and anchors once for each block.  The
first turn finds an anchor's positives, the second its negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, importable

#: Components become floor(SCALE * x).
SCALE = 256
#: Rows with a component of this size or more take no part: their products need not fit 64 bits.
LARGE = float(1 << 16)
#: Rows of a block: a 64th of all, between these two.
LEAST, MOST = 2048, 262_144
#: Rows and anchors whose products are held at once.
TILE, AT_ONCE = 2048, 128
#: Pairs are worked on one by one when one in SPARSE is left.
SPARSE = 4
LOWEST = np.iinfo(np.int64).min


def part_of(value: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * value / 100) without leaving 64 bits."""
    return value // 100 * percent + value % 100 * percent // 100


def best(group: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, by score, then id; sorted by group."""
    order = np.lexsort((id, -score, group))
    start = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order))) < k]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; shorter ones end in zeros."""
    offsets, out = column.offsets.to_numpy(), np.zeros((len(column), dims), np.int32)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


class Block:
    """Rows by label and id, each once, as packed bit planes (plane, row, bytes of components)."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int, planes: int):
        table = pa.Table.from_batches(parts).select(["id", "label", "q"]).combine_chunks()
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        q = matrix(table.column("q").chunk(0), dims)
        order = np.lexsort((*q.T[::-1], ids, labels))
        ids, labels, q = ids[order], labels[order], q[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (q[1:] != q[:-1]).any(1)
        self.ids, self.labels, q = ids[fresh], labels[fresh], q[fresh]
        self.dims = dims
        self.planes = np.stack([np.packbits((q >> b & 1).astype(np.uint8), axis=1) for b in range(planes)])

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def pairs(self, anchors: np.ndarray, own: np.ndarray, lo: int, hi: int, possible: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and product of the pairs with rows lo to hi that stay possible to the last plane.

        ``possible(low, high, which)`` says which intervals can still qualify; ``which`` has the anchor of each pair, or
        is None where all anchors meet all rows.  Rows with an anchor's own id are left out.
        """
        below, above = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
        small = np.abs(anchors).max(initial=0) * self.dims < 1 << 24
        a = anchors.astype(np.float32 if small else np.float64)  # sums of components under a plane are exact in it
        dense = np.zeros((len(a), hi - lo), np.int64)
        foreign = self.ids[None, lo:hi] != own[:, None]
        keep, which, row, product = foreign, None, None, None
        last = len(self.planes) - 1
        for b in range(last, -1, -1):
            bits = np.unpackbits(self.planes[b, lo:hi], axis=1, count=self.dims)
            weight, rest = -(1 << b) if b == last else 1 << b, (1 << b) - 1
            if which is None:
                dense += weight * (a @ bits.T.astype(a.dtype)).astype(np.int64)
                keep = foreign & possible(np.where(foreign, dense + rest * below[:, None], LOWEST), dense + rest * above[:, None], None)
                if np.count_nonzero(keep) * SPARSE <= keep.size:
                    which, row = np.nonzero(keep)
                    product = dense[which, row]
            else:
                product += weight * np.einsum("ij,ij->i", a[which], bits[row], dtype=a.dtype).astype(np.int64)
                keep = possible(product + rest * below[which], product + rest * above[which], which)
                which, row, product = which[keep], row[keep], product[keep]
        if which is None:
            which, row = np.nonzero(keep)
            product = dense[which, row]
        return which, row + lo, product

    def positives(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, id and product of the k best of the same label."""
        held = [np.zeros(0, np.int64)] * 3
        bar = np.full(len(anchors), LOWEST)
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            first, end = self.of_label(label)
            for lo in range(first, end, TILE):
                hi = min(lo + TILE, end)

                def possible(low: np.ndarray, high: np.ndarray, which: np.ndarray | None) -> np.ndarray:
                    if which is not None:
                        return high >= bar[mine[which]]
                    if hi - lo > k and (bar[mine] == LOWEST).any():  # k rows have this much at least
                        bar[mine] = np.maximum(bar[mine], np.partition(low, hi - lo - k, axis=1)[:, hi - lo - k])
                    return high >= bar[mine, None]

                which, row, product = self.pairs(anchors[mine], own[mine], lo, hi, possible)
                held = [np.concatenate(x) for x in zip(held, (mine[which], self.ids[row], product))]
                held = [x[best(held[0], held[2], held[1], k)] for x in held]
                count = np.bincount(held[0], minlength=len(anchors))
                full = np.flatnonzero(count == k)
                bar[full] = held[2][(np.cumsum(count) - 1)[full]]
        return tuple(held)

    def negatives(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the range, id and product of the k best of other labels with products from least to most.

        Anchor i has the ranges ``least[i]`` to ``most[i]``; their numbers go on from anchor to anchor.
        """
        held, bar = [np.zeros(0, np.int64)] * 3, least.copy()
        ranges = least.shape[1]
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            first, end = self.of_label(label)
            for lo, hi in [(x, min(x + TILE, stop)) for start, stop in ((0, first), (end, len(self.ids))) for x in range(start, stop, TILE)]:
                lowest, highest = bar[mine].min(1, initial=np.iinfo(np.int64).max), most[mine].max(1, initial=LOWEST)

                def possible(low: np.ndarray, high: np.ndarray, which: np.ndarray | None) -> np.ndarray:
                    if which is None:
                        return (high >= lowest[:, None]) & (low <= highest[:, None])
                    at = mine[which]
                    return np.logical_or.reduce([(high >= bar[at, j]) & (low <= most[at, j]) for j in range(ranges)]) if ranges else np.zeros(len(at), bool)

                which, row, product = self.pairs(anchors[mine], own[mine], lo, hi, possible)
                at = mine[which]
                for j in range(ranges):
                    fits = (product >= bar[at, j]) & (product <= most[at, j])
                    held = [np.concatenate(x) for x in zip(held, (at[fits] * ranges + j, self.ids[row[fits]], product[fits]))]
                held = [x[best(held[0], held[2], held[1], k)] for x in held]
                count = np.bincount(held[0], minlength=bar.size)
                full = np.flatnonzero(count == k)
                bar.ravel()[full] = held[2][(np.cumsum(count) - 1)[full]]
        return tuple(held)


def _visit(work: Callable, dims: int, planes: int) -> Callable:
    """Rows sorted by block and side: the rows of a block (side 0), then the anchors that visit it (side 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("c", "side")], 1)
            edges = [0, *(np.flatnonzero(np.any(at[1:] != at[:-1], axis=1)) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                now, side = at[lo].tolist()
                if now != key:
                    key, parts, block = now, [], None
                if side == 0:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if block is None and parts:
                    block, parts = Block(parts, dims, planes), []
                for start in range(lo, hi, AT_ONCE) if block else ():
                    some = batch.slice(start, min(AT_ONCE, hi - start))
                    yield work(block, some, matrix(some.column("q"), dims).astype(np.int64), *(some.column(c).to_numpy() for c in ("id", "label")))

    return scan


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for whose id ``is_anchor`` holds; their positives are the first rows of the same label with
    another id.  For each, the first rows of other labels whose score is from ``low`` to ``high`` per cent of the
    positive's; a negative positive score admits none.  Ties go to the smaller id.

    Rows with a null id, label or vector, a null or non-finite component, or one of 65536 or more in size take no part.
    A vector shorter than others (an empty one too) counts as ending in zeros.  Rows alike in id, label and vector are
    one; rows with one id that differ in the rest are rows of their own, but not each other's positives or negatives.
    Labels and ids are integers.  Anchors without positives, and positives without negatives, give no rows; nor does
    an empty table.  Other columns are dropped.
    """
    spark = rows.sparkSession
    importable(spark)
    scratch = Scratch(spark, "negatives")
    wide = lambda x: x.cast("double")
    fine = lambda x: F.coalesce(F.abs(wide(x)) < LARGE, F.lit(False))  # noqa: E731  NaN is larger than all numbers
    some = rows.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v"))
    some = some.dropna(subset=["id", "label", "v"]).filter(F.forall("v", fine))
    some = scratch.write(some.select("id", "label", F.transform("v", lambda x: F.floor(wide(x) * SCALE).cast("int")).alias("q")), "rows")
    size = some.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(F.array_max("q")).alias("top"), F.min(F.array_min("q")).alias("bottom")).first()
    if not size["n"]:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dims, planes = max(size["dims"], 1), 1 + max((size["top"] or 0).bit_length(), (~(size["bottom"] or 0) if (size["bottom"] or 0) < 0 else 0).bit_length())
    blocks = max(1, -(-size["n"] // min(MOST, max(LEAST, size["n"] // 64))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    key = F.xxhash64("id", "label", "q")
    some = some.withColumn("key", key)
    none = F.lit(None).cast("array<struct<at:int,id:bigint,score:bigint>>")

    def meet(anchors: DataFrame, work: Callable, schema: str, name: str) -> DataFrame:
        dealt = some.select(F.pmod("key", F.lit(blocks)).alias("c"), F.lit(0).alias("side"), "id", "label", "q", "key", none.alias("near"))
        sent = anchors.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("c"), F.lit(1).alias("side"), "id", "label", "q", "key", "near")
        spread = dealt.unionByName(sent).repartition(tasks, "c").sortWithinPartitions("c", "side")
        return scratch.write(spread.mapInArrow(_visit(work, dims, planes), schema), name)

    def nearest(block: Block, batch: pa.RecordBatch, q: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        which, found, score = block.positives(q, ids, labels, positives)
        return pa.RecordBatch.from_arrays([pa.array(ids[which]), batch.column("key").take(pa.array(which)), pa.array(found), pa.array(score)], names=["id", "key", "other", "score"])

    anchors = some.filter(is_anchor(F.col("id"))).dropDuplicates(["id", "label", "q"]).withColumn("near", none)
    near = meet(anchors, nearest, "id bigint, key bigint, other bigint, score bigint", "near")
    first = Window.partitionBy("id", "key").orderBy(F.desc("score"), "other")
    near = near.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= positives)
    near = near.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("at", F.col("other").alias("id"), "score"))).alias("near"))  # `positives` of them

    def between(block: Block, batch: pa.RecordBatch, q: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        lists = batch.column("near")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        begin, score, other = offsets[0], flat.field("score").to_numpy(), flat.field("id").to_numpy()
        n = np.diff(offsets)
        who, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        score, other = score[begin : offsets[-1]], other[begin : offsets[-1]]
        least, most = np.full((len(n), positives), np.iinfo(np.int64).max), np.full((len(n), positives), LOWEST)
        least[who, place], most[who, place] = -part_of(-score, low), part_of(score, high)
        group, found, theirs = block.negatives(q, ids, labels, least, most, negatives)
        cell = np.zeros((len(n), positives), np.int64)
        cell[who, place] = np.arange(len(who))
        who, place, source = group // positives, group % positives, cell.ravel()[group]
        columns = [pa.array(ids[who]), batch.column("key").take(pa.array(who)), pa.array(place.astype(np.int32)), pa.array(other[source]), pa.array(score[source]), pa.array(found), pa.array(theirs)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor_id", "key", "at", "positive_id", "positive_score", "negative_id", "negative_score"])

    asked = scratch.write(anchors.drop("near").join(near, ["id", "key"]), "asked")
    found = meet(asked, between, "anchor_id bigint, key bigint, at int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", "found")
    order = Window.partitionBy("anchor_id", "key", "at").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    out = scratch.write(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "out")
    scratch.drop("rows", "near", "asked", "found")
    return out
