"""SimHash near-duplicates: bit-sliced comparison of fingerprints inside exact bands.

Fingerprints are made where the documents lie.  Only distinct ones are
compared.  64 bits in four bands: two that differ in at most two bits agree on
at least two bands, so they meet in one of six groups.  A group above
``GROUP`` members is dealt anew by the bits that are still free, again in four
bands; after two such steps eight bits are free and a group of distinct
fingerprints has 256 members at most.  So no link is lost and none is found by
comparing all with all.

Inside a block the fingerprints stand as bit planes, one 64-bit word for 64 of
them.  For each shift, planes are compared a word at a time and carry-save
counters add up the distances of all lanes; words whose lanes all exceed the
radius, or are linked already, are abandoned.  What leaves a task is a spanning
forest of its links, no more edges than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.components import connected_components

from .common import Scratch, importable

RADIUS = 2
SHINGLE = 3
#: Members of a group that one block compares; larger groups are dealt by more bits.
GROUP = 512
#: Rows that a task compares at once.
SLAB = 100_000
SHINGLES_AT_ONCE = 200_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BIT = 64


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; a text without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes, owners, counts = [], [], []

    def flush() -> None:
        if hashes:
            h = np.array(hashes, np.dtype("<u8"))
            starts = np.cumsum(counts) - np.array(counts)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            majority = 2 * ones > np.array(counts)[:, None]
            out[owners] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
        hashes.clear(), owners.clear(), counts.clear()

    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate([[0], ends[:-1] + 1])
        last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
        spans = zip(first[: len(last)].tolist(), last.tolist())
        hashes += [xxh64_intdigest(joined[a:b], seed) for a, b in spans]
        owners.append(k)
        counts.append(len(last))
        if len(hashes) >= SHINGLES_AT_ONCE:
            flush()
    flush()
    return out


def with_fingerprint(docs: DataFrame, columns: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The named columns and ``fp``, the fingerprint as a signed long."""
    importable(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(batch.num_columns - 1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    chosen = docs.select(*columns, F.col(text).alias("__text"))
    return chosen.mapInArrow(scan, ", ".join([*(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in columns), "fp bigint"]))


def masks(free: list[int], parts: int = 4) -> list[tuple[int, list[int]]]:
    """For free bit positions in ``parts`` bands: (bits held, bits still free) for each choice of RADIUS bands left free."""
    bands = [free[k * len(free) // parts : (k + 1) * len(free) // parts] for k in range(parts)]
    out = []
    for loose in combinations(range(parts), RADIUS):
        left = [b for k in loose for b in bands[k]]
        out.append((sum(1 << b for k in range(parts) if k not in loose for b in bands[k]), left))
    return out


def levels() -> list[list[int]]:
    """Masks of the three levels; mask k of a level leads to masks 6k to 6k + 5 of the next."""
    level, out = [(0, list(range(BIT)))], []
    for _ in range(3):
        level = [(held | more, left) for held, free in level for more, left in masks(free)]
        out.append([m for m, _ in level])
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(groups: np.ndarray, fps: np.ndarray, label: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group and two labels whose fingerprints differ in at most ``radius`` bits.

    Rows are sorted by group; a fingerprint is one 64-bit word or several.
    Pairs come by their distance in rows, (a, a + shift), so labels that the
    caller unites meanwhile are not compared again.
    """
    n, bits = len(fps), BIT * (fps.size // max(1, len(fps)))
    width = -(-n // BIT)
    flat = np.zeros((bits, (width + 1) * BIT), np.uint8)
    flat[:, :n] = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    planes = np.packbits(flat, axis=1, bitorder="little").view("<u8")
    del flat
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    longest = int(np.diff(np.append(starts, n)).max()) if n else 0
    for shift in range(1, longest):
        open_ = np.zeros(width * BIT, bool)
        open_[: n - shift] = (groups[:-shift] == groups[shift:]) & (label[:-shift] != label[shift:])
        alive = np.packbits(open_, bitorder="little").view("<u8")
        at = np.flatnonzero(alive)
        if not len(at):
            continue
        alive = alive[at]
        by, off = divmod(shift, BIT)
        low, high = np.uint64(off), np.uint64(BIT - off)
        counters, over = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))], np.zeros(len(at), np.uint64)
        for b in range(0, bits, 8):
            chunk = planes[b : b + 8]
            near = chunk[:, np.minimum(at + by, width)]
            moved = near >> low | chunk[:, np.minimum(at + by + 1, width)] << high if off else near
            differ = chunk[:, at] ^ moved
            for x, y in zip(differ[::2], differ[1::2]):
                half = counters[0] ^ x
                carry = counters[0] & x | half & y  # a full adder: two planes and the ones counter
                counters[0] = half ^ y
                for c in range(1, len(counters)):
                    counters[c], carry = counters[c] ^ carry, counters[c] & carry
                over |= carry
            alive = alive & ~_above(counters, over, radius)
            keep = alive != 0
            if not keep.all():
                at, alive, over, counters = at[keep], alive[keep], over[keep], [c[keep] for c in counters]
                if not len(at):
                    break
        if len(at):
            found = np.unpackbits(alive.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            row, lane = np.nonzero(found)
            a = at[row] * BIT + lane
            yield a, a + shift


def link_block(groups: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group: the least row that each is linked to, over links inside its group."""
    label = np.arange(len(fps))
    for a, b in close_pairs(groups, fps, label, radius):
        unite(label, a, b)
    return label


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    more, equal = over.copy(), ~np.zeros_like(over)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = label[a], label[b]
        split = x != y
        if not split.any():
            return
        a, b, least = a[split], b[split], np.minimum(x, y)[split]
        np.minimum.at(label, x[split], least)
        np.minimum.at(label, y[split], least)
        while not np.array_equal(label, root := label[label]):
            label[:] = root


def slabs(batches: Iterator[pa.RecordBatch], keys: int, most: int = 0) -> Iterator[np.ndarray]:
    """Sorted rows of integers as matrices of ``most`` (SLAB) rows or so; one ends where a group, the first ``keys`` columns, does."""
    kept: list[np.ndarray] = []
    held, most = 0, most or SLAB
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        kept.append(rows)
        held += len(rows)
        if held >= most:
            rows = np.concatenate(kept)
            cut = np.flatnonzero(np.any(rows[1:, :keys] != rows[:-1, :keys], axis=1))
            if len(cut):
                yield rows[: cut[-1] + 1]
                kept, held = [rows[cut[-1] + 1 :]], len(rows) - cut[-1] - 1
            else:
                kept = [rows]
    if held:
        yield np.concatenate(kept)


def numbered(keys: np.ndarray) -> np.ndarray:
    """Number of the group of each sorted row."""
    return np.concatenate([[0], np.cumsum(np.any(keys[1:] != keys[:-1], axis=1))])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of groups in sorted rows (m, key, fp)."""
    for rows in slabs(batches, 2):
        label = link_block(numbered(rows[:, :2]), rows[:, 2].astype(np.uint64))
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[moved, 2]), pa.array(rows[label[moved], 2])], names=["u", "v"])


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that span the same components as all pairs of distinct ``fp`` within the radius."""
    rows, found, steps = distinct.select(F.lit(0).alias("parent"), "fp"), None, levels()
    for depth, level in enumerate(steps):
        per = 6
        table = F.array(*(F.lit(signed(m)) for m in level))
        child = F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("child")
        dealt = rows.select("parent", "fp", child).select((F.col("parent") * per + F.col("child")).alias("m"), "fp")
        dealt = dealt.select("m", F.get(table, F.col("m")).bitwiseAND(F.col("fp")).alias("key"), "fp")
        counts = dealt.groupBy("m", "key").agg(F.count("*").alias("n")).filter("n > 1")
        met = scratch.write(dealt.join(counts, ["m", "key"]), f"met-{depth}")
        last = depth == len(steps) - 1
        small = met if last else met.filter(F.col("n") <= GROUP)
        n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = small.select("m", "key", "fp").repartition(n, "m", "key").sortWithinPartitions("m", "key").mapInArrow(_forest, "u bigint, v bigint")
        found = edges if found is None else found.unionByName(edges)
        rows = met.filter(F.col("n") > GROUP).select(F.col("m").alias("parent"), "fp")
        if last or rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, columns: list[str] | None = None, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Each row's id (or the columns named instead), fingerprint as 16 hex digits, component_id, and root, one number per component.

    component_id is the smallest id reachable over links, the row's own
    included; null ids are never the smallest, and a component of null ids
    alone has a null component_id.  Null and empty texts have fingerprint 0 and
    link like any other.  Rows alike share all results.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    columns = columns or [id]
    scratch = Scratch(spark, "simhash")
    marked = scratch.write(with_fingerprint(docs, columns, text, shingle), "fingerprints")
    distinct = scratch.write(marked.groupBy("fp").agg(F.min(id).alias("first")), "distinct")
    roots = connected_components(links(distinct, scratch), scratch)
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = scratch.write(members.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", "root"), "classes")
    scratch.drop("distinct", "met-0", "met-1", "met-2")
    joined = marked.join(classes, marked["fp"] == classes["_fp"])
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return joined.select(*columns, hexed.alias("fingerprint"), "component_id", "root")
