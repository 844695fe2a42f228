"""Source divergence audit: how the sources of a language differ in their words.

Tokenizer: a lookup table over the concatenated UTF-8 bytes of many texts finds
the borders of terms (ASCII letters and all bytes above 127).  The slices are
grouped by their xxhash; every slice is then compared with the first of its
group byte by byte, and slices that differ make groups of their own.  Each
chunk of texts gives a sparse document by term matrix, which is summed to
(language, source, term) rows before anything is shuffled.

Divergences: the kept terms of a language are dealt into blocks, each with the
totals of all its sources.  A task holds a part of a block as a sparse source
by term matrix in CSR form; terms that a source lacks have one common
probability, so only stored entries are visited, and sums over a source's terms
are ``np.add.reduceat`` over its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, importable, join_dimension
from .tokens import ragged

SCALE = 1_000_000_000
#: Bytes of text that are tokenized at once, in whole documents.
CHUNK_BYTES = 8_000_000
#: Kept terms of one block, sources of one range, and stored entries worked on at once; they bound a task's memory and change no result.
TERMS = 16_384
SOURCES = 1024
ENTRIES = 100_000

_BYTE = np.arange(256)
#: Bytes of terms, and bytes with A-Z lower-cased.
IN_TERM = (_BYTE >= 128) | ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE >= 65)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of documents that lie one after the other; none reaches over a document's border."""
    inside = IN_TERM[data]
    before = np.concatenate([[False], inside[:-1]])[: len(data)]
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders], after[borders - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def grouped(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A group number for each slice, and one slice of each group; slices of one group have the same bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = data.tobytes()
    hashes = np.fromiter((digest(whole[a:b]) for a, b in zip(starts.tolist(), (starts + lengths).tolist())), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    mate = first[group]
    wrong = lengths != lengths[mate]
    at = np.flatnonzero(~wrong & (mate != np.arange(len(starts))))
    if len(at):
        differs = ragged(data, starts[at], lengths[at]) != ragged(data, starts[mate[at]], lengths[at])
        wrong[at] = np.add.reduceat(differs, np.cumsum(lengths[at]) - lengths[at]) > 0
    if wrong.any():  # one hash for different bytes
        known: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(wrong).tolist():
            term = whole[starts[k] : starts[k] + lengths[k]]
            if term not in known:
                known[term] = len(first) + len(known)
                extra.append(k)
            group[k] = known[term]
        first = np.concatenate([first, extra])
    return group, first


def counted(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(owner, term, occurrences, documents) of texts that belong to numbered owners."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = LOWER[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    starts, ends = slices(data, offsets)
    term, first = grouped(data, starts, ends - starts)
    document = np.searchsorted(offsets, starts, "right") - 1
    cells, n = np.unique(document * max(len(first), 1) + term, return_counts=True)  # a sparse document by term matrix
    document, term = np.divmod(cells, max(len(first), 1))
    cells = owner[document] * max(len(first), 1) + term
    order = np.argsort(cells, kind="stable")
    begin = np.flatnonzero(np.diff(cells[order], prepend=-1))
    n, docs = (np.add.reduceat(n[order], begin), np.diff(begin, append=len(order))) if len(order) else (n, n)
    owner, term = np.divmod(cells[order][begin], max(len(first), 1))
    lengths = (ends - starts)[first][term]
    flat = ragged(data, starts[first][term], lengths)
    buffers = [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(flat.tobytes())]
    return owner, pa.LargeStringArray.from_buffers(len(term), buffers[1], buffers[2]).cast(pa.string()), n, docs


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), some whole documents at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + CHUNK_BYTES, "right")))
            part = batch.slice(lo, hi - lo)
            groups = list(zip(*(c.to_pylist() for c in part.columns[:2])))
            names = list(dict.fromkeys(groups))
            owner = np.fromiter(map({x: k for k, x in enumerate(names)}.__getitem__, groups), np.int64, len(groups))
            owner, term, n, docs = counted(part.column(2), owner)
            which = pa.array(owner)
            lang, source = (pa.array([x[k] for x in names], pa.string()).take(which) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            lo = hi


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), by long division in three steps, exact up to 9 * 10**15."""
    whole, rest = np.divmod(n + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    return (p - q) * (p - q) // q


class Block:
    """The sources of a language, those that this task answers for, and what the terms seen so far add up to."""

    def __init__(self, sources: list[str], totals: np.ndarray, vocabulary: int, mine: np.ndarray, top: int):
        self.sources, self.vocabulary, self.mine, self.top = sources, vocabulary, np.flatnonzero(mine), top
        self.names = pa.array(sources, pa.string())
        self.totals = totals
        self.all = int(totals.sum())
        self.none = share(np.zeros(len(sources), np.int64), np.maximum(totals + vocabulary, 1))
        self.sums = np.zeros((len(self.mine), len(sources)), np.int64)
        self.terms: list[str] = []
        self.best = np.zeros((0, 3), np.int64)  # source, value, number of the term
        self.row = np.full(len(sources), -1)
        self.row[self.mine] = np.arange(len(self.mine))

    def add(self, table: pa.Table) -> None:
        """Stored entries (source, term, n, ln), whole terms in ascending order."""
        term = table.column("term").combine_chunks()
        names = pc.unique(term)
        column = pc.index_in(term, names).to_numpy(zero_copy_only=False).astype(np.int64)
        source = pc.index_in(table.column("source").combine_chunks(), self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        n, ln = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "ln"))
        p = share(n, self.totals[source] + self.vocabulary)
        self._terms(source, column, p, share(ln, np.full(len(ln), self.all + self.vocabulary)), names)
        order = np.lexsort((column, source))
        row, column, p = source[order], column[order], p[order]  # CSR by source
        edge = np.searchsorted(row, np.arange(len(self.sources) + 1))
        stored = np.diff(edge)
        own = np.flatnonzero(self.row[row] >= 0)
        row_own, column_own, p_own = self.row[row[own]], column[own], p[own]
        begin = np.flatnonzero(np.diff(row_own, prepend=-1))
        rows = row_own[begin]
        none = self.none[self.mine]
        for h in range(len(self.sources)):
            q = np.full(len(names), self.none[h])
            has = np.zeros(len(names), bool)
            mine = slice(edge[h], edge[h + 1])
            q[column[mine]], has[column[mine]] = p[mine], True
            lacking = np.array([apart(x, p[mine]).sum() for x in none])  # as if a source had none of h's terms
            rest = len(names) - stored[self.mine] - stored[h]
            if len(own):
                theirs, shared = q[column_own], has[column_own]
                self.sums[rows, h] += np.add.reduceat(apart(p_own, theirs), begin)
                lacking[rows] -= np.add.reduceat(np.where(shared, apart(none[row_own], theirs), 0), begin)
                rest[rows] += np.add.reduceat(shared.astype(np.int64), begin)
            self.sums[:, h] += lacking + rest * apart(none, self.none[h])

    def _terms(self, source: np.ndarray, column: np.ndarray, p: np.ndarray, q: np.ndarray, names: pa.Array) -> None:
        """Keep the best ``top`` terms of each source that uses them more than the language does."""
        more = (p > q) & (self.row[source] >= 0)
        found = np.stack([source[more], apart(p[more], q[more]), column[more] + len(self.terms)], 1)
        every = np.concatenate([self.best, found])
        every = every[np.lexsort((every[:, 2], -every[:, 1], every[:, 0]))]
        start = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
        place = np.arange(len(every)) - np.repeat(start, np.diff(start, append=len(every)))
        every = every[place < self.top]
        held, number = np.unique(every[:, 2], return_inverse=True)  # numbers go on ascending with the terms
        old = len(self.terms)
        fresh = names.take(pa.array(held[held >= old] - old)).to_pylist()
        self.terms = [self.terms[k] for k in held[held < old]] + fresh
        self.best = np.stack([every[:, 0], every[:, 1], number.reshape(-1)], 1)

    def result(self, lang: str) -> pa.RecordBatch:
        g, h = np.divmod(np.arange(self.sums.size), len(self.sources))
        other = self.mine[g] != h
        source = np.concatenate([self.mine[g[other]], self.best[:, 0]])
        item = [self.sources[k] for k in h[other]] + [self.terms[k] for k in self.best[:, 2]]
        value = np.concatenate([self.sums.ravel()[other], self.best[:, 1]])
        part = ["pair"] * int(other.sum()) + ["term"] * len(self.best)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(item), pa.string()), self.names.take(pa.array(source)), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _deal(top: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by lang, block, range, side, term: a block's sources (side 0), then its entries (side 1)."""
        key, heads, block, parts, held = None, [], None, [], 0

        def opened() -> Block:
            head = pa.Table.from_batches(heads).sort_by("source")
            return Block(head.column("source").to_pylist(), head.column("n").to_numpy(), head.column("ln")[0].as_py(), head.column("mine").to_numpy(zero_copy_only=False).astype(bool), top)

        def flush(last: bool) -> None:
            """Add the parts to the block but for the last term, which may go on in the next batch."""
            nonlocal parts, held
            if not parts:
                return
            table = pa.Table.from_batches(parts)
            cut = table.num_rows
            if not last:
                same = pc.equal(table.column("term"), table.column("term")[cut - 1]).to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(same)[0])
            if cut:
                block.add(table.slice(0, cut))
            parts = table.slice(cut).combine_chunks().to_batches() if cut < table.num_rows else []
            held = table.num_rows - cut

        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("lang", "block", "range", "side")]
            keys = list(zip(*ids))
            edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                now, side = keys[lo][:3], keys[lo][3]
                if now != key:
                    if heads:
                        block = block or opened()
                        flush(True)
                        yield block.result(key[0])
                    key, heads, block, parts, held = now, [], None, [], 0
                run = batch.slice(lo, hi - lo)
                if side == 0:
                    heads.append(run)
                    continue
                block = block or opened()
                parts.append(run)
                held += run.num_rows
                if held >= ENTRIES:
                    flush(False)
        if heads:
            block = block or opened()
            flush(True)
            yield block.result(key[0])

    return work


def audit(docs: DataFrame, least: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: a source's distance to each other one, and the terms that set it off.

    Null texts, languages and sources are read as ''.  A language keeps the terms that at least ``least`` of its
    documents hold, each row being a document, rows alike too.  ``pair`` has all other sources, ``term`` the first
    ``top`` terms that the source uses more than its language does.  Ties go by the item's bytes.  A language whose
    sources have no kept term has pairs of value 0; one with a single source has no pairs.  An empty table gives an
    empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark, "divergence")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(scan, "lang string, source string, term string, n bigint, docs bigint")
    counts = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    held = counts.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("ln"), (F.min("source").over(term) == F.col("source")).cast("bigint").alias("first"))
    kept = scratch.write(held.filter(F.col("df") >= least).drop("df"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = scratch.write(groups, "groups")
    ceil = lambda c, by: F.greatest(F.ceil(c / by), F.lit(1)).cast("bigint")
    langs = groups.groupBy("lang").agg(F.sum("v").alias("vocabulary"), ceil(F.sum("v"), TERMS).alias("blocks"), ceil(F.count("*"), SOURCES).alias("ranges"))
    langs = scratch.write(langs, "langs")
    n = langs.count()
    if not n:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value bigint, rank int")
    zero = F.lit(0).cast("bigint")
    dealt = lambda c, by: F.pmod(F.xxhash64(c), F.col(by))
    ranges = lambda df: df.withColumn("range", F.explode(F.sequence(zero, F.col("ranges") - 1)))
    heads = ranges(join_dimension(groups, langs, "lang", n)).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    heads = heads.select("lang", "block", "range", F.lit(0).alias("side"), F.lit("").alias("term"), "source", "n", F.col("vocabulary").alias("ln"), (dealt("source", "ranges") == F.col("range")).alias("mine"))
    entries = ranges(join_dimension(kept, langs, "lang", n).withColumn("block", dealt("term", "blocks")))
    entries = entries.select("lang", "block", "range", F.lit(1).alias("side"), "term", "source", "n", "ln", F.lit(False).alias("mine"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), langs.agg(F.sum(F.col("blocks") * F.col("ranges"))).first()[0])
    spread = heads.unionByName(entries).repartition(tasks, "lang", "block", "range").sortWithinPartitions("lang", "block", "range", "side", "term")
    parts = scratch.write(spread.mapInArrow(_deal(top), "lang string, source string, part string, item string, value bigint"), "parts")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    terms = ranked(parts.filter("part = 'term'")).filter(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
