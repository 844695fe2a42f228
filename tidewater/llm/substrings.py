"""Substring dedup: prefix-partitioned suffix trees, cut at the depth that counts.

A text is a string of words and each window of ``window`` words is a suffix,
of which only the first ``window`` words matter.  What is asked of the suffix
tree of the corpus is which of its nodes at that depth have two leaves or more:
their suffixes repeat, and where such suffixes follow each other in a document
they make up its maximal repeats.

Suffixes are split by prefixes that depend on the words alone, so that equal
suffixes always meet.  The prefix of a window is the one of its ``GRAM``-word
substrings with the smallest hash (a minimizer) instead of its first words, as
neighbouring windows mostly share it: a run of them travels as one row, with
its words.  Prefixes have different lengths: the windows under each are counted
first, and one with more than ``BOUND`` is lengthened to whole windows, dealt
into as many groups as it needs.  So every group fits in memory before anything
moves.  A task reads its groups in the order of their prefixes and holds about
``PART`` windows at a time; of a window that comes more often it holds one.

A group's tree is its suffixes in the order of their words, with the number of
words that each shares with the one before it; neighbours that share ``window``
words or more are under one internal node.  Suffixes whose hash no other has
are leaves of their own and never enter the order.  Hashes only set suffixes
apart; what counts as a repeat has been compared word by word.

Before anything moves, each task compares the windows of about a million words
with each other: of a window that occurs there more than once, all places are
marked and one is sent.  So no group of copies sends more rows than there are
such chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, importable, join_dimension, row_key, spare

WINDOW = 35
GRAM = 5
#: Words, at six bytes each, that a task compares before it sends; windows that a task holds.
CHUNK = 1_000_000
PART = 250_000
#: Windows of one shuffle partition, and of one group.
SHARD = 3_000_000
BOUND = 500_000
#: Suffixes that one sort by words takes, and those of one group beyond it.
SLAB = 32_768
#: Rows of an Arrow batch that leaves a task.
ROWS = 50_000

BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    from xxhash import xxh3_64_intdigest

    raw = [(t or "").encode("utf-8", "surrogatepass").translate(BLANK) for t in texts]
    lists = pc.split_pattern(pa.array(raw, pa.large_binary()), b" ")
    coded = lists.flatten().dictionary_encode()
    which, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    value = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))[which]
    bounds = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return value[which[real]], np.diff(bounds)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(x: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the hash of the words from each place on: a polynomial in an odd base, mixed."""
    up, down = powers(len(x) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * down[:-1], dtype=np.uint64)])
    return [mix((sums[n:] - sums[:-n]) * up[: max(0, len(x) + 1 - n)]) if len(x) >= n else np.zeros(0, np.uint64) for n in lengths]


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of x[i : i + width], for each i, by doubling."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at, have = np.where(x[a] <= x[b], a, b), have + step
    return at


class Words:
    """The words of byte strings: the rank of each among all in the order of bytes, and where the words of each string begin."""

    def __init__(self, raw: list[bytes]):
        lists = pc.split_pattern(pa.array(raw, pa.large_binary()), b" ")
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        some = real.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        flat = flat if some.all() else flat.filter(real)
        coded = flat.dictionary_encode()
        self.which, self.dictionary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        rank = np.zeros(len(self.dictionary), ">u4")
        rank[pc.array_sort_indices(self.dictionary).to_numpy()] = np.arange(len(rank))
        self.rank, self.counts, self.begin = rank[self.which], np.diff(bounds), bounds[:-1]
        self.flat = flat

    def values(self) -> np.ndarray:
        """A hash of each word, the same in all tasks."""
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, self.dictionary.to_pylist()), np.uint64, len(self.dictionary))[self.which]

    def slices(self, first: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """The words from each first place to before each last, joined by one blank."""
        if not len(first):
            return []
        if self.flat is not None:
            self.spaced = pc.binary_join_element_wise(self.flat, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
            self.flat = None
        offsets = np.frombuffer(self.spaced.buffers()[1], np.int64)[self.spaced.offset :]
        data = memoryview(self.spaced.buffers()[2])
        return [bytes(data[x : y - 1]) for x, y in zip(offsets[first].tolist(), offsets[upto].tolist())]


def shared_words(rows: np.ndarray) -> np.ndarray:
    """How many first words each row but the first shares with the row before it."""
    out = np.full(max(0, len(rows) - 1), rows.shape[1])
    for lo in range(0, len(out), SLAB):
        differ = rows[lo + 1 : lo + SLAB + 1] != rows[lo : min(lo + SLAB, len(out))]
        some = differ.any(1)
        out[lo : lo + SLAB][some] = differ[some].argmax(1)
    return out


def nodes(words: Words, place: np.ndarray, hash: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For each suffix (its first word's place) the first one of its group under the same node at full depth."""
    node = np.arange(len(place))
    order = np.lexsort((hash, group))
    twin = (hash[order][1:] == hash[order][:-1]) & (group[order][1:] == group[order][:-1])
    own = np.zeros(len(order), bool)
    own[1:][twin] = own[:-1][twin] = True
    inner = order[own]  # all others are leaves that no node at this depth has beside another
    head = np.flatnonzero(np.diff(group[inner], prepend=~group[inner[:1]]) != 0)
    slab = np.repeat(head // SLAB, np.diff(np.append(head, len(inner))))
    ends = np.append(np.flatnonzero(np.diff(slab)) + 1, len(inner)).tolist() if len(inner) else []
    for lo, hi in zip([0, *ends], ends):
        part = inner[lo:hi]
        rows = np.ascontiguousarray(words.rank[place[part][:, None] + np.arange(window)])
        by_words = np.lexsort((rows.view(f"S{4 * window}").ravel(), group[part]))
        part, rows = part[by_words], rows[by_words]
        new = np.concatenate([[True], (shared_words(rows) < window) | (group[part][1:] != group[part][:-1])])
        node[part] = part[new][np.cumsum(new) - 1]
    return node


def longer(prefix: np.ndarray, hash: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The prefixes of whole windows in place of heavy ones, in so many parts."""
    return label(mix(prefix + np.uint64(1) + mix(hash) % parts))


def label(hash: np.ndarray) -> np.ndarray:
    """32 bits of a hash.  Prefixes with one label share a group, which costs nothing, as words are compared there."""
    return hash >> np.uint64(32)


def to_column(label: np.ndarray) -> pa.Array:
    return pa.array(label.astype(np.uint32).view(np.int32))


def from_column(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint32).astype(np.uint64)


SENT = ("prefix", "a", "b", "start", "upto", "words")
SENT_SCHEMA = "prefix int, a bigint, b bigint, start int, upto int, words binary"


def sent_rows(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, upto: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    ints = [pa.array(x.astype(np.int32)) for x in (start, upto)]
    return pa.RecordBatch.from_arrays([to_column(prefix), pa.array(a), pa.array(b), *ints, pa.array(words, pa.binary())], names=SENT)


class Chunk:
    """Windows of some whole documents: what to send, and what is known to repeat."""

    def __init__(self, texts: list[str | None], window: int, gram: int):
        self.words, self.window = Words([(t or "").encode("utf-8", "surrogatepass").translate(BLANK) for t in texts]), window
        value = self.words.values()
        (whole,), (grams,) = (rolling(value, (k,)) for k in (window, gram))
        n = np.maximum(self.words.counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)  # window's place in its document
        self.place = self.at + self.words.begin[self.doc]
        some = len(self.place) > 0
        self.hash = whole[self.place] if some else np.zeros(0, np.uint64)
        self.anchor = first_least(grams, window - gram + 1)[self.place] if some else self.place
        self.prefix = label(grams[self.anchor]) if some else np.zeros(0, np.uint64)
        node = nodes(self.words, self.place, self.hash, self.prefix, window)
        self.again = np.bincount(node, minlength=len(node))[node] > 1
        self.send = node == np.arange(len(node))

    def lengthen(self, heavy: np.ndarray, parts: np.ndarray) -> None:
        """Give windows under the heavy prefixes (sorted) the prefix of their whole words."""
        if not len(heavy) or not len(self.prefix):
            return
        at = np.minimum(np.searchsorted(heavy, self.prefix), len(heavy) - 1)
        own = heavy[at] == self.prefix
        self.prefix[own] = longer(self.prefix[own], self.hash[own], parts[at[own]])

    def sizes(self) -> pa.RecordBatch:
        prefix, n = np.unique(self.prefix[self.send], return_counts=True)
        return pa.RecordBatch.from_arrays([to_column(prefix), pa.array(n)], names=["prefix", "n"])

    def rows(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs of windows to send with their words, then spans that are known to repeat, with none."""
        sent = np.flatnonzero(self.send)
        head, tail = runs(self.doc[sent], self.at[sent], self.anchor[sent], self.prefix[sent])
        for lo in range(0, len(head), ROWS):
            x, y = sent[head[lo : lo + ROWS]], sent[tail[lo : lo + ROWS]]
            doc = self.doc[x]
            yield sent_rows(self.prefix[x], a[doc], b[doc], self.at[x], np.zeros(len(x)), self.words.slices(self.place[x], self.place[y] + self.window))
        start, upto, doc = spans(self.doc, self.at, np.flatnonzero(self.again), self.window)
        yield sent_rows(label(mix(a[doc].view(np.uint64))), a[doc], b[doc], start, upto, [b""] * len(doc))


def runs(doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive windows of one document that are alike in all of ``same``."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) != 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(doc)) - 1 if len(head) else head


def spans(doc: np.ndarray, at: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one document as (first word, word behind the last, document)."""
    d, a = doc[places], at[places]
    head, tail = runs(d, a)
    return a[head], a[tail] + window, d[head]


def _chunks(batches: Iterator[pa.RecordBatch], window: int, gram: int, most: int) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """Chunks of whole texts from rows (a, b, text), with the keys of their documents."""
    texts, keys, size = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts += (own := part.column(2).to_pylist())
            keys.append([part.column(c).to_numpy() for c in range(2)])
            size += sum(len(t or "") for t in own)
            if size >= 6 * most:
                yield Chunk(texts, window, gram), *map(np.concatenate, zip(*keys))
                texts, keys, size = [], [], 0
                pa.default_memory_pool().release_unused()
    if keys:
        yield Chunk(texts, window, gram), *map(np.concatenate, zip(*keys))


def _lengthen(window: int):
    """Rows as sent with a last column parts: those with a number there are split by the prefixes of whole windows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = pc.and_(pc.is_valid(batch.column(6)), pc.greater(pc.binary_length(batch.column(5)), 0))
            yield batch.filter(pc.invert(heavy)).select(list(SENT))
            rest = batch.filter(heavy)
            if not len(rest):
                continue
            prefix, (a, b, start) = from_column(rest.column(0)), (rest.column(c).to_numpy() for c in range(1, 4))
            words = Words(rest.column(5).to_pylist())
            row, at, place = suffixes(words, window)
            prefix = longer(prefix[row], rolling(words.values(), (window,))[0][place], rest.column(6).to_numpy().astype(np.uint64)[row])
            head, tail = runs(row, at, prefix)
            x = row[head]
            yield sent_rows(prefix[head], a[x], b[x], start[x] + at[head], np.zeros(len(x)), words.slices(place[head], place[tail] + window))

    return split


def suffixes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all strings: string, place in it, and place among all words."""
    n = np.maximum(words.counts - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, at, words.begin[row] + at


class Held:
    """Runs of suffixes that a task holds: prefix, key, place in the text, whether they have been told, and their words."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, told: np.ndarray, words: list[bytes], window: int) -> None:
        if len(words):
            self.parts.append((prefix, a, b, start, told, words))
            self.size += sum(w.count(b" ") for w in words) + len(words) * (2 - window)

    def grow(self, window: int, last: bool) -> pa.RecordBatch:
        """Spans of the suffixes under nodes with two leaves or more that were not told before.

        Unless it is the last time, of each suffix under the highest prefix,
        which may go on, one stays.
        """
        if not self.parts:
            return _spans_of(*(np.zeros(0, np.int64),) * 3, window)
        *columns, raw = zip(*self.parts)
        prefix, a, b, start, told = map(np.concatenate, columns)
        words = Words([w for part in raw for w in part])
        self.parts, self.size = [], 0
        row, at, place = suffixes(words, window)
        hash = rolling(mix(words.rank.astype(np.uint64) + np.uint64(1)), (window,))[0][place]
        node = nodes(words, place, hash, prefix[row], window)
        again = np.bincount(node)[node] > 1
        out = np.flatnonzero(again & ~told[row])
        if not last:
            stay = np.flatnonzero((node == np.arange(len(node))) & (prefix[row] == prefix[-1]))
            known = (again | told[row])[stay]
            head, tail = runs(row[stay], at[stay], known)
            x, y = stay[head], stay[tail]
            self.add(prefix[row[x]], a[row[x]], b[row[x]], start[row[x]] + at[x], known[head], words.slices(place[x], place[y] + window), window)
        return _spans_of(a[row[out]], b[row[out]], (start[row] + at)[out], window)


def _spans_of(a: np.ndarray, b: np.ndarray, place: np.ndarray, window: int) -> pa.RecordBatch:
    order = np.lexsort((place, b, a))
    a, b, place = a[order], b[order], place[order]
    head, tail = runs(a, place, b)
    return _told(a[head], b[head], place[head], place[tail] + window)


def _told(a: np.ndarray, b: np.ndarray, start: np.ndarray, upto: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(start.astype(np.int32)), pa.array(upto.astype(np.int32))], names=["a", "b", "start", "upto"])


def _subtrees(window: int, part: int):
    """Per shuffle partition, sorted by prefix: the suffixes under nodes at full depth with two leaves or more, as spans of words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = Held(), part
        for batch in batches:
            known = batch.column(4).to_numpy() > 0
            if known.any():
                yield _told(*(batch.column(c).to_numpy()[known] for c in (1, 2, 3, 4)))
            rest = batch.filter(pa.array(~known)) if known.any() else batch
            a, b, start = (rest.column(c).to_numpy() for c in range(1, 4))
            held.add(from_column(rest.column(0)), a, b, start.astype(np.int64), np.zeros(len(rest), bool), rest.column(5).to_pylist(), window)
            if held.size >= limit:
                yield held.grow(window, last=False)
                pa.default_memory_pool().release_unused()
                limit = max(part, 2 * held.size)
        yield held.grow(window, last=True)

    return build


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns
        rows = []
        for text, spans_ in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            kept, at = [], 0
            for s in spans_ or ():
                if s["start"] > at:
                    kept += words[at : s["start"]]
                at = max(at, s["upto"])
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        a, b, c = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=[*batch.schema.names[: n - 2], "n_words", "n_removed", "kept"])


def heavy_prefixes(docs: DataFrame, window: int, gram: int, text: str) -> DataFrame:
    """Prefixes with more than BOUND windows, and the parts that each is dealt into.  All windows that would be sent are counted."""
    most = CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _ in _chunks(batches, window, gram, most):
            yield chunk.sizes()
            del chunk  # before the next one is made

    sizes = docs.select("a", "b", text).mapInArrow(count, "prefix int, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    return sizes.filter(F.col("n") > BOUND).select("prefix", F.ceil(F.col("n") / BOUND).cast("bigint").alias("parts"))


def in_order(heavy: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Heavy prefixes as sorted numbers, and their parts; for at most BROADCAST_ROWS."""
    rows = sorted((r["prefix"] % (1 << 32), r["parts"]) for r in heavy.collect())
    return np.array([h for h, _ in rows], np.uint64), np.array([p for _, p in rows], np.uint64)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """(a, b, spans): the words of each text that lie in repeated windows, as sorted (start, upto), for the key of columns a and b.

    Up to BROADCAST_ROWS heavy prefixes are told to the tasks, which lengthen
    them as they send; more are joined to the rows sent.
    """
    spark = docs.sparkSession
    importable(spark)
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // 6 // SHARD)
    heavy = Scratch(spark, "heavy").write(heavy_prefixes(docs, window, gram, text), "heavy")
    many, most = heavy.count(), CHUNK
    told = spark.sparkContext.broadcast(in_order(heavy if many <= BROADCAST_ROWS else heavy.limit(0)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, a, b in _chunks(batches, window, gram, most):
            chunk.lengthen(*told.value)
            yield from chunk.rows(a, b)
            del chunk

    sent = docs.select("a", "b", text).mapInArrow(send, SENT_SCHEMA)
    if many > BROADCAST_ROWS:
        sent = join_dimension(sent, heavy, "prefix", many).select(*SENT, "parts").mapInArrow(_lengthen(window), SENT_SCHEMA)
    found = sent.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees(window, PART), "a bigint, b bigint, start int, upto int")
    return found.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("start", "upto"))).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept, the text of the words in no repeated window, joined by one blank.

    Repetition is judged on the input.  Null and empty texts, and texts shorter
    than a window, lose nothing.  Rows alike in id and text are copies of each
    other and lose all that windows cover.  An empty table gives an empty
    result.  Other columns are dropped.  Texts meet their spans by a 128-bit
    hash of id and text.
    """
    named = spare("text", [id])
    keyed = docs.select(F.col(id).alias(spare("id", [])), F.col(text).alias(named), row_key(id, text).alias("key"))
    keyed = keyed.select(spare("id", []), named, "key.a", "key.b")
    scratch = Scratch(docs.sparkSession, "substrings")
    found = scratch.write(repeated_spans(keyed, window, gram, named), "spans")
    joined = keyed.join(found, ["a", "b"], "left").select(F.col(spare("id", [])).alias(id), named, "spans")
    kind = docs.schema[id].dataType.simpleString()
    return joined.mapInArrow(_keep, f"`{id}` {kind}, n_words bigint, n_removed bigint, kept string")
