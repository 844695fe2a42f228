"""Pairs of a crowded block within an edit similarity: tiles of two chunks of its texts, compared with all prefixes in common worked once.

Texts of few edits are compared by both tries (near_tries).  For more edits a
chunk's texts are the rows of arrays; the texts of the other are read in
order, letter by letter, against all of them.  For each row the cells of the
edit matrix within e edits are the bits of one word, one bit for each diagonal
in reach; a row without a bit is dropped with all texts that begin so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import near_tries
from tidewater.storage import Scratch, importable

#: Most edits of a pair here (diagonals are the bits of one word), texts of a chunk of few and of many texts, chunks from which on they grow, most tasks, pairs of a batch, and bytes kept of letters found.
EDITS = 31
CHUNK, LARGE_CHUNK, PARTS, TASKS = 2048, 65536, 48, 2000
BATCH, KEPT_BYTES = 1 << 17, 1 << 26


def edits(n: int | np.ndarray, threshold: float) -> np.ndarray:
    """Edits that a pair may have whose longer text has n letters."""
    return np.floor(np.asarray(n) * (1 - threshold) + 1e-9).astype(np.int64)


def tiles(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, similarity) of the texts (class, text, block, n), distinct in a block, that are within the threshold; a < b."""
    importable(texts.sparkSession)
    total = texts.count()
    parts = max(1, min(total // CHUNK, max(PARTS, total // LARGE_CHUNK)))
    ranged = texts.repartitionByRange(parts, "block", "n", "text").groupBy("block", F.spark_partition_id().alias("part"))
    packed = ranged.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("text", "class")).alias("rows"))
    packed = scratch.write(packed.select("block", "part", "low", "high", F.col("rows.text").alias("texts"), F.col("rows.class").alias("classes")), "chunks")
    sized = packed.select("block", "part", "low", "high")
    other = sized.select("block", F.col("part").alias("q"), F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    reach = lambda n: F.floor(n / threshold + 1e-9)  # noqa: E731  # the longest text that one of n letters is like
    met = sized.withColumnRenamed("part", "p").join(other, "block").filter((F.col("p") <= F.col("q")) & (F.col("q_low") <= reach(F.col("high"))) & (F.col("low") <= reach(F.col("q_high"))))
    sides = met.select("block", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("part")).join(packed.drop("low", "high"), ["block", "part"])
    kind = texts.schema["class"].dataType.simpleString()
    each = min(parts * (parts + 1) // 2, TASKS)  # asked for by number: by their bytes tiles would be few tasks
    return sides.select("block", "p", "q", "texts", "classes").repartition(each, "block", "p", "q").groupBy("block", "p", "q").applyInArrow(_comparer(threshold), f"a {kind}, b {kind}, similarity double")


def _comparer(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(texts.as_py(), classes.values) for batch in batches for texts, classes in zip(batch["texts"], batch["classes"])]  # one or two chunks
        (x, x_class), (y, y_class) = held[0], held[-1]
        same = len(held) == 1
        classes = x_class if same else pa.concat_arrays([x_class, y_class])
        rank = np.empty(len(classes), np.int32)
        rank[pc.array_sort_indices(classes).to_numpy()] = np.arange(len(classes), dtype=np.int32)
        behind = 0 if same else len(x)
        found: tuple[list, list, list] = ([], [], [])
        size = 0

        def out() -> pa.RecordBatch:
            i, j, s = (np.concatenate(f) for f in found)
            for f in found:
                f.clear()
            less = rank[i] < rank[j]
            a, b = (classes.take(pa.array(np.where(less, *ids))) for ids in ((i, j), (j, i)))
            return pa.RecordBatch.from_arrays([a, b, pa.array(s)], ["a", "b", "similarity"])

        for i, j, similarity in _similar(x, y, threshold, same):
            found[0].append(i)
            found[1].append(j + behind)
            found[2].append(similarity)
            size += len(i)
            if size >= BATCH:
                yield out()
                size = 0
        if size:
            yield out()

    return compare


def _similar(x: list[str], y: list[str], threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x, places in y and similarities of pairs; of one list, each pair once.  Pairs of few edits by tries of each length, others letter by letter."""
    few = 1
    while few <= max(map(len, (*x, *y))) and edits(few, threshold) <= near_tries.EDITS:
        few += 1  # the least length with more edits
    of_x = _by_length(x, few)
    of_y = of_x if same else _by_length(y, few)
    for m, (rows, left) in of_x.items():
        for n, (others, right) in of_y.items():
            k = int(edits(max(m, n), threshold))
            if abs(m - n) <= k and not (same and m > n):
                for i, j, distance in near_tries.near(left, right, k, same and m == n):
                    yield rows[i], others[j], (1 - np.arange(k + 1) / max(m, n))[distance]
    long = lambda texts: np.array([i for i, t in enumerate(texts) if len(t) >= few], np.int64)
    short = lambda texts: np.array([i for i, t in enumerate(texts) if len(t) < few], np.int64)
    for rows, others in ((np.arange(len(x)), long(y)), *([] if same else [(long(x), short(y))])):
        if len(rows) and len(others):
            for at, i, distance, longer in near([x[r] for r in rows], [y[r] for r in others], threshold):
                i, j = rows[i], others[at]
                longer = np.broadcast_to(longer, i.shape)
                good = longer >= few
                if same:
                    good &= (i < j) | np.array([len(x[r]) < few for r in i], bool)
                yield i[good], np.full(int(good.sum()), j), 1 - distance[good] / longer[good]


def _by_length(texts: list[str], below: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the texts in their order, and their letters in rows."""
    places: dict[int, list[int]] = {}
    for i in sorted(range(len(texts)), key=texts.__getitem__):
        if len(texts[i]) < below:
            places.setdefault(len(texts[i]), []).append(i)
    return {n: (np.array(at, np.int64), np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, n)) for n, at in places.items()}


def near(x: list[str], y: list[str], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of y that is like some of x: its place, their places, the edit distances and the longer lengths."""
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    m, high = np.array([len(t) for t in x]), max(map(len, y))
    longest = max(int(m.max()), high)
    k = int(edits(longest, threshold))
    word = np.uint32 if 2 * k + 1 < 32 else np.uint64
    one = word(1)
    letters = np.zeros((longest + 2 * k + 1, len(x)), np.uint32)  # a column a text, k zeros before it
    for i, t in enumerate(x):
        letters[k : k + len(t), i] = code(t)
    hits: dict[tuple[int, int], np.ndarray] = {}

    def hit(j: int, letter: int) -> np.ndarray:
        """Diagonals on which the text's letter j is the row's."""
        if (found := hits.get((j, letter))) is None:
            if len(hits) * len(x) * word().nbytes > KEPT_BYTES:
                hits.clear()
            found = np.zeros(len(x), word)
            for d in range(2 * k + 1):
                found |= (letters[j + d] == letter).astype(word) << word(d)
            hits[j, letter] = found
        return found

    start = np.empty((k + 1, len(x)), word)
    for e in range(k + 1):
        start[e] = sum(1 << (k + d) for d in range(e + 1))
    steps, last = [(None, start, m)], ""  # rows (all: None), their bits and lengths after each letter of the text before
    for at in sorted(range(len(y)), key=y.__getitem__):
        text = y[at]
        same = 0
        for p, q in zip(text, last):
            if p != q:
                break
            same += 1
        del steps[same + 1 :]
        last = text[: len(steps) - 1]
        rows, bits, n = steps[-1]
        for j in range(len(steps) - 1, len(text)):
            if not len(n):
                break
            match = hit(j, ord(text[j]))
            new = bits & (match if rows is None else match[rows])
            if k:
                new[1:] |= bits[:-1] | bits[:-1] >> one
                for e in range(1, k + 1):
                    new[e] |= new[e - 1] << one
            live = np.flatnonzero(new[k])
            if len(live) < 0.75 * len(n):
                rows = live if rows is None else rows[live]
                new, n = new[:, live], n[live]
            bits = new
            steps.append((rows, bits, n))
            last = text[: j + 1]
        if not len(n):
            continue
        shift = n - len(text) + k
        near_by = np.flatnonzero((shift >= 0) & (shift <= 2 * k))
        ends = bits[:, near_by] >> shift[near_by].astype(word) & one
        distance = k + 1 - ends.sum(axis=0, dtype=np.int64)
        longer = np.maximum(n[near_by], len(text))
        good = np.flatnonzero(distance <= edits(longer, threshold))
        if len(good):
            found = near_by[good]
            yield at, found if rows is None else rows[found], distance[good], longer[good]
