"""SimHash near-duplicates of a given similarity: bit-sliced comparison in blocks, then an exact check.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more; links form components, and one text of each stays.
Bands of fingerprint bits, as ``simhash`` has for two bits, would have no bits
left at the distances that such texts have.  So fingerprints of 128 bits are
compared inside blocks of texts that agree in one of ``BANDS`` bands of
``ROWS`` minima; at similarity 0.8 a pair shares none with a chance of
(1 - 0.8^6)^36 = 2e-5, and exceeds ``RADIUS`` bits with one below 1e-5.

A block can hold a large part of all texts, so it is worked off in turns.  In
each, a component that is known by now has one member in a block, blocks above
``BLOCK`` members are dealt in pieces, and the bit planes give each member its
nearest one of another component: no more pairs than members.  These pairs are
checked on the whole sets of shingles, kept as 64-bit hashes, and components
grow.  Pieces and members change from turn to turn, so a block of copies of one
text is one component after two or three.  What is still open after ``TURNS``
is compared in full, by bit planes first: a block of up to ``FEW`` members
gives its pairs within the radius, to be checked as before; a larger one, in
pairs of pieces, has the sets beside it and is checked where it lies, so only
links that join two components leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.components import connected_components

from .common import Scratch, importable, row_key, spare
from .simhash import LOWER, close_pairs, numbered, slabs, unite
from .substrings import mix, rolling, word_hashes

SIMILARITY = 0.8
SHINGLE = 5
BANDS = 36
ROWS = 6
#: 64-bit words of a fingerprint, and the distance up to which texts are checked.  At similarity 0.8 it is 19 bits on
#: average, 24 for texts of a few shingles, with a deviation of 4.5.
WORDS = 2
RADIUS = 44
TURNS = 3
#: Members of a block, or of a piece of one, that a task compares at once; shingles of a piece; members that may leave as pairs.
BLOCK = 4096
SHINGLES = 1 << 20
FEW = 24
#: Bytes of the bitmaps of a piece; sets that need more are merged pair by pair.
BITMAPS = 1 << 26
#: Words that a task hashes at once.
AT_ONCE = 100_000
SEED = 11


def shingles(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, shingles per text, and a hash of each text's words (0: no words).

    A text of fewer words is one shingle.
    """
    lowered = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass") for t in texts]
    hashes, counts = word_hashes(lowered)
    begin = np.cumsum(counts) - counts
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    start = np.cumsum(n) - n
    long = counts >= shingle
    take = np.repeat(long, n)
    place = np.arange(int(n.sum())) - np.repeat(start, n) + np.repeat(begin, n)
    out = np.zeros(len(place), np.uint64)
    if take.any():
        out[take] = rolling(hashes, (shingle,))[0][place[take]]
    for k in np.flatnonzero(~long & (counts > 0)).tolist():
        out[start[k]] = rolling(hashes[begin[k] : begin[k] + counts[k]], (int(counts[k]),))[0][0]
    same = np.zeros(len(counts), np.uint64)
    for k in np.flatnonzero(counts).tolist():
        same[k] = rolling(hashes[begin[k] : begin[k] + counts[k]], (int(counts[k]),))[0][0]
    return out, n, same


def unique_in_texts(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's hashes, and its size."""
    ends = np.cumsum(n)
    each = [np.unique(hashes[b - c : b]) for b, c in zip(ends.tolist(), n.tolist())]
    return (np.concatenate(each) if each else hashes), np.fromiter(map(len, each), np.int64, len(each))


def band_keys(hashes: np.ndarray, n: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each text with shingles, one key a band."""
    rng = np.random.default_rng(SEED)
    by = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    start = (np.cumsum(n) - n)[n > 0]
    out = np.zeros((len(start), bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(hashes * by[k], start)
        band = k // rows
        out[:, band] = mix((out[:, band] if k % rows else np.full(len(start), band, np.uint64)) * np.uint64(31) + least)
    return out


def signatures(hashes: np.ndarray, n: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each text with shingles, its SimHash of ``words`` times 64 bits; each shingle of the set counts once."""
    start, size = (np.cumsum(n) - n)[n > 0], n[n > 0][:, None]
    out = np.zeros((len(start), words), np.uint64)
    for k in range(words):
        own = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _in_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of texts of about AT_ONCE words each, judged by characters."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= 6 * AT_ONCE:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for lo, hi in _in_parts(texts):
            hashes, n, same = shingles(texts[lo:hi])
            hashes, n = unique_in_texts(hashes, n)
            some = bool(n.any())
            lists = []
            for wide, values in ((WORDS, signatures(hashes, n) if some else np.zeros(0, np.uint64)), (BANDS, band_keys(hashes, n) if some else np.zeros(0, np.uint64))):
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, wide, 0))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().view(np.int64))))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(same.view(np.int64)), pa.array(n), *lists], names=[*part.schema.names[:-1], "same", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in _in_parts(texts):
            hashes, n = unique_in_texts(*shingles(texts[lo:hi])[:2])
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], names=["same", "set"])


def _candidates(similarity: float, every: bool):
    """Pairs from rows (band, piece, root, same, size, words of the fingerprint), sorted by band and piece.

    With ``every`` all within the radius, else each row's nearest; pairs of one
    component, and of sets whose sizes alone rule the similarity out, do not count.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slabs(batches, 2):
            root, same, size, fps = rows[:, 2], rows[:, 3], rows[:, 4], np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
            distance, other = np.full(len(rows), RADIUS + 1), np.full(len(rows), -1)
            found = []
            for a, b in close_pairs(numbered(rows[:, :2]), fps, root, RADIUS):
                fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[fits], b[fits]
                if every:
                    found.append(np.stack([a, b]))
                    continue
                d = np.bitwise_count(fps[a] ^ fps[b]).sum(1)
                for x, y in ((a, b), (b, a)):
                    nearer = d < distance[x]
                    distance[x[nearer]], other[x[nearer]] = d[nearer], y[nearer]
            some = np.flatnonzero(other >= 0)
            a, b = np.concatenate(found, 1) if found else np.stack([some, other[some]])
            u, v = np.minimum(same[a], same[b]), np.maximum(same[a], same[b])
            pairs = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return scan


class Overlaps:
    """How many hashes two sets of a piece share: bitmaps over those that more than one set has, or merges of sorted sets where these would be large."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, most: int):
        known, which, n = np.unique(values, return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        words = int(place[-1] // 64 + 1) if len(place) and place[-1] >= 0 else 1
        self.bits = None
        if 8 * words * len(lengths) <= most:
            row, at = np.repeat(np.arange(len(lengths)), lengths)[n[which] > 1], place[which[n[which] > 1]]
            self.bits = np.zeros((len(lengths), words), np.uint64)
            np.bitwise_or.at(self.bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            self.step = max(1, (most >> 3) // words)
        else:
            ends = np.cumsum(lengths)
            self.sets = [np.sort(values[b - c : b]) for b, c in zip(ends.tolist(), lengths.tolist())]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.fromiter((len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a))
        parts = [np.bitwise_count(self.bits[a[k : k + self.step]] & self.bits[b[k : k + self.step]]).sum(1, dtype=np.int64) for k in range(0, len(a), self.step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def links_of_piece(rows: np.ndarray, values: np.ndarray, lengths: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Links (u, v) between components of one piece, from rows as _candidates has them and the sets; no more than join them."""
    _, first, which = np.unique(rows[:, 2], return_index=True, return_inverse=True)
    label, same, size, fps = first[which], rows[:, 3], rows[:, 4], np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
    overlaps, out = Overlaps(values, lengths, most), [np.zeros((0, 2), np.int64)]
    for a, b in close_pairs(np.zeros(len(rows), np.int64), fps, label, RADIUS):
        fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[fits], b[fits]
        both = overlaps(a, b)
        alike = both >= similarity * (size[a] + size[b] - both) - 1e-9
        a, b = a[alike], b[alike]
        if len(a):
            _, once = np.unique(np.sort(np.stack([label[a], label[b]], 1), axis=1), axis=0, return_index=True)
            out.append(np.stack([same[a[once]], same[b[once]]], 1))
            unite(label, a[once], b[once])
    return np.concatenate(out)


def _checked_links(similarity: float, most: int):
    """links_of_piece for each piece of rows sorted by band and piece, with their sets in the last column."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        pairs = links_of_piece(*(np.concatenate(x) for x in zip(*held)), similarity, most)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            n = batch.num_columns - 1
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:n]], 1)
            column = batch.column(n)
            offsets, values = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy()
            borders = (np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1).tolist()
            for lo, hi in zip([0, *borders], [*borders, len(rows)]):
                if lo == hi:
                    continue
                if held and (held[0][0][0, :2] != rows[lo, :2]).any():
                    yield done(held)
                    held = []
                held.append((rows[lo:hi], values[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1])))
        if held:
            yield done(held)

    return scan


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets of hashes overlap so far; built-in, as Arrow batches of pairs of sets take much memory."""
    most, both = F.greatest(F.size(x), F.size(y)), F.size(F.array_intersect(x, y))
    return (F.least(F.size(x), F.size(y)) >= similarity * most - 1e-9) & (both >= similarity * (F.size(x) + F.size(y) - both) - 1e-9)


NUMBERS = ("same", "size", *(f"f{k}" for k in range(WORDS)))


def _one_each(open_: DataFrame, turn: int) -> DataFrame:
    """One row of each component of a block, in pieces."""
    one = F.min(F.struct(F.xxhash64("same", F.lit(turn)).alias("h"), *NUMBERS)).alias("x")
    one = open_.groupBy("band", "root").agg(one).select("band", "root", *(F.col(f"x.{c}").alias(c) for c in NUMBERS))
    sizes = one.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    rows = one.join(sizes, "band").withColumn("piece", F.pmod(F.xxhash64("same", F.lit(-turn)), F.col("parts")))
    return rows.select("band", "piece", "root", *NUMBERS)


def _all(open_: DataFrame, few: bool) -> DataFrame:
    """All rows of the blocks of up to FEW members, or of the others, these in pairs of pieces."""
    sizes = open_.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter(F.col("n") <= FEW if few else F.col("n") > FEW)
    if few:
        return open_.join(sizes.select("band"), "band").select("band", F.lit(0).cast("bigint").alias("piece"), "root", *NUMBERS)
    sizes = sizes.select("band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / SHINGLES)).alias("parts"))
    rows = open_.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("same"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return rows.select("band", (F.least("own", "with") * F.col("parts") + F.greatest("own", "with")).alias("piece"), "root", *NUMBERS)


def classes(docs: DataFrame, key: Column, id: str, text: str, similarity: float, scratch: Scratch) -> DataFrame:
    """One row per row of docs: id, key, and root, one number per component."""
    spark = docs.sparkSession
    importable(spark)
    keyed = docs.select(F.col(id).alias("id"), key.alias("key"), F.col(text).alias("text"))
    schema = f"id {docs.schema[id].dataType.simpleString()}, key {keyed.schema['key'].dataType.simpleString()}, same bigint, size bigint, fp array<bigint>, bands array<bigint>"
    wide = scratch.write(keyed.mapInArrow(_mark, schema), "wide")
    marked = scratch.write(wide.select("id", "key", "same"), "marked")
    distinct = scratch.write(wide.groupBy("same").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    scratch.drop("wide")
    dealt = distinct.select(F.explode("bands").alias("band"), "same", "size", *(F.get("fp", F.lit(k)).alias(f"f{k}") for k in range(WORDS)))
    crowded = dealt.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    met = scratch.write(dealt.join(crowded, "band"), "met")
    pick = distinct.join(met.select("same").distinct(), "same", "left_semi").select("key", "same")
    sets = scratch.write(keyed.select("key", "text").join(pick, "key").select("same", "text").mapInArrow(_sets, "same bigint, set array<bigint>").dropDuplicates(["same"]), "sets")
    scratch.drop("distinct")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_pieces = lambda rows: rows.repartition(parts, "band", "piece").sortWithinPartitions("band", "piece", "same")
    roots, links, checked = None, None, None
    for turn in range(TURNS + 1):
        rows = met.withColumn("root", F.col("same"))
        if roots is not None:
            rows = met.join(roots, met["same"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "same"))
            still = rows.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
            rows = scratch.write(rows.join(still, "band"), f"open-{turn}")
            if rows.isEmpty():
                break
        last = turn == TURNS
        pairs = in_pieces(_all(rows, few=True) if last else _one_each(rows, turn)).mapInArrow(_candidates(similarity, last), "u bigint, v bigint").distinct()
        pairs = scratch.write(pairs if checked is None else pairs.join(checked, ["u", "v"], "left_anti"), f"pairs-{turn}")
        checked = pairs if checked is None else checked.unionByName(pairs)
        with_sets = pairs.join(sets.select(F.col("same").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("same").alias("v"), F.col("set").alias("y")), "v")
        new = with_sets.filter(_alike(F.col("x"), F.col("y"), similarity)).select("u", "v")
        if last:
            many = in_pieces(_all(rows, few=False).join(sets, "same").select("band", "piece", "root", *NUMBERS, "set"))
            new = new.unionByName(many.mapInArrow(_checked_links(similarity, BITMAPS), "u bigint, v bigint").distinct())
        new = scratch.write(new, f"links-{turn}")
        scratch.drop(f"open-{turn}")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        roots = connected_components(links, Scratch(spark, f"copies-{turn}"))
    scratch.drop("sets", "met")
    if roots is None:
        return marked.withColumn("root", F.col("same")).drop("same")
    return marked.join(roots, marked["same"] == roots["node"], "left").select("id", "key", F.coalesce("root", "same").alias("root"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component: the one with the smallest id, a null id only where there is no other.

    Null and empty texts are copies of each other.  Rows alike count as one.
    All columns stay as they are, whatever their names.
    """
    name = spare("key", docs.columns)
    scratch = Scratch(docs.sparkSession, "copies")
    classed = classes(docs, row_key(id, text), id, text, similarity, scratch)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("first")
    kept = scratch.write(classed.groupBy("root").agg(first, F.count("*").alias("n"), F.count_distinct("key").alias("keys")).select(F.col("first.key").alias(name), "n", "keys"), "kept")
    repeated = not kept.filter("n > keys").isEmpty()  # rows alike, of which all would stay
    scratch.drop("marked")
    out = docs.withColumn(name, row_key(id, text)).join(kept.select(name), name, "left_semi")
    return (out.dropDuplicates([name]) if repeated else out).drop(name)
