"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its
beginnings, so that a stem counts in words never seen.  Filters of widths 1, 2
and 3 slide over the words; each keeps its maximum over the whole text, and a
logistic layer makes the score.  Training reads a bounded sample of labelled
rows, the same number of each label, in one task; the driver sees the finished
model only.  Scoring reads every word of every text where it lies.

Thresholds are calibrated by language.  The language is guessed from the text
itself, from the share of function words; the score is bent so that the
threshold of its language becomes 0.5.  A language's own threshold counts by
the texts of its rarer label that it rests on, the common one of all languages
as ``SHRINK`` of them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, importable
from .substrings import BLANK
from .tokens import ragged

#: Bounds of the training sample: rows of each label, and characters of all of them.  Whole rows are left out, none is cut.
SAMPLE = 1500
SAMPLE_CHARS = 10_000_000
#: Texts that the common threshold counts for beside a language's own.
SHRINK = 15
BUCKETS = 1 << 15
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 5, 6, 7)
EPOCHS = 12
SEED = 5
#: Words whose embeddings a Python worker remembers.
MEMO = 400_000
#: Words of one training batch, of which a longer text is one by itself.
BATCH_WORDS = 100_000
#: Words that pooling takes at once, and sampled texts that coding takes at once; both only bound memory.
AT_ONCE = 50_000
CODE_TEXTS = 256

# Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as this be at from".split(),
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine".split(),
    "fr": "le la les et des du un une pour dans est par sur au qui que".split(),
    "es": "el los las y que se del una por con para es su no al lo".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
STRIP = b".,;:!?\"'()[]|*#%&$<>"


def pieces(word: bytes) -> list[int]:
    """Buckets of a word (lower case, without marks around it) and of its beginnings."""
    w = word.decode("utf-8", "replace")
    parts = [w, *(w[:n] + "*" for n in PREFIXES if len(w) > n - 1)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def coded(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers of all texts, the distinct words, and words per text."""
    raw = [(t or "").lower().encode("utf-8", "replace").translate(BLANK) for t in texts]
    lists = pc.split_pattern(pa.array(raw, pa.large_binary()), b" ")
    table = lists.flatten().dictionary_encode()
    which = table.indices.to_numpy(zero_copy_only=False)
    words = [w.strip(STRIP) for w in table.dictionary.to_pylist()]
    real = np.fromiter(map(bool, words), bool, len(words))[which]
    bounds = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return which[real], words, np.diff(bounds)


def coded_in_parts(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The same as coded(), some texts at a time, so that the copies it makes stay small.  Words are numbered as they appear."""
    numbers, words, which, counts = {}, [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(texts), CODE_TEXTS):
        own, some, n = coded(texts[lo : lo + CODE_TEXTS])
        to = np.fromiter((numbers.setdefault(w, len(numbers)) for w in some), np.int32, len(some))
        words += list(numbers)[len(words) :] if len(numbers) > len(words) else []
        which.append(to[own]), counts.append(n)
    return np.concatenate(which), words, np.concatenate(counts)


def languages(which: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES of each text: the one with most function words; 'other' if it has none."""
    hits = np.zeros((len(counts), len(FUNCTION_WORDS)), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for k, own in enumerate(FUNCTION_WORDS.values()):
        known = {w.encode() for w in own}
        mine = np.fromiter((w in known for w in words), bool, len(words))
        hits[:, k] = np.bincount(owner[mine[which]], minlength=len(counts))
    return np.where(hits.max(1) > 0, hits.argmax(1), len(FUNCTION_WORDS))


class Model:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
        self.kernels = [rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.thresholds = np.full(len(LANGUAGES), 0.5)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.vectors = np.zeros((0, DIMS), np.float32)

    def word_vectors(self, words: list[bytes]) -> np.ndarray:
        """Embeddings of words, with a memo, as most words of a batch have been seen before."""
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            parts = [pieces(words[k]) for k in missing.tolist()]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.fromiter(chain.from_iterable(parts), np.int64, int(n.sum()))
            new = np.add.reduceat(self.embedding[flat], np.cumsum(n) - n, axis=0)
            out = np.empty((len(words), DIMS), np.float32)
            out[at >= 0], out[missing] = self.vectors[at[at >= 0]], new
            if len(self.memo) < MEMO:
                for k in missing.tolist():
                    self.memo.setdefault(words[k], len(self.memo))
                grown = np.empty((len(self.memo), DIMS), np.float32)
                grown[: len(self.vectors)] = self.vectors
                grown[[self.memo[words[k]] for k in missing.tolist()]] = new
                self.vectors = grown
            return out
        return self.vectors[at]

    def pooled(self, vectors: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of each filter over each text, after a ramp, and the places of the maxima (-1: none)."""
        begin = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        out, places = [], []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.bias):
            tables = [np.concatenate([vectors @ kernel[k], np.zeros((1, FILTERS), np.float32)]) for k in range(width)]  # the last row: beyond the text
            conv = tables[0][which]
            for k in range(1, width):
                nxt = np.concatenate([which[k:], np.full(k, len(vectors))])[: len(which)]
                for j in range(1, k + 1):  # the last words of a text have nothing behind them
                    ends = begin[some] + counts[some] - j
                    nxt[ends[counts[some] >= j]] = len(vectors)
                conv = conv + tables[k][nxt]
            top = np.zeros((len(counts), FILTERS), np.float32)
            if len(some):
                top[some] = np.maximum.reduceat(conv, begin[some], axis=0) + bias
            out.append(np.maximum(top, 0))
            places.append(conv)
        return np.concatenate(out, 1), places

    def raw(self, which: np.ndarray, words: list[bytes], counts: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
        vectors, out, lo = self.word_vectors(words), [], 0
        ends = np.cumsum(counts)
        while lo < len(counts):
            before = ends[lo] - counts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + at_once, "right")))
            top, _ = self.pooled(vectors, which[before : ends[hi - 1]], counts[lo:hi])
            out.append(1 / (1 + np.exp(-np.clip(top @ self.out + self.out_bias, -30, 30))))
            lo = hi
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        which, words, counts = coded(texts)
        p = self.raw(which, words, counts)
        t = self.thresholds[languages(which, words, counts)]
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / np.maximum(1 - t, 1e-9))


def batched(order: np.ndarray, counts: np.ndarray, most: int = 64) -> Iterator[np.ndarray]:
    """Texts in order, up to ``most`` and BATCH_WORDS words at once; each text is whole."""
    ends, lo = np.cumsum(counts[order]), 0
    while lo < len(order):
        room = int(np.searchsorted(ends, ends[lo] - counts[order[lo]] + BATCH_WORDS, "right"))
        hi = min(lo + most, max(lo + 1, room))
        yield order[lo:hi]
        lo = hi


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the logistic loss in small batches of texts; one text in five is left for the thresholds."""
    model, rng = Model(seed), np.random.default_rng(seed + 1)
    if not len(texts) or labels.min() == labels.max():
        model.out[:] = 0
        model.out_bias = np.float32(-4 if not len(texts) or labels[0] == 0 else 4)
        return model
    which, words, counts = coded_in_parts(texts)
    begin = np.cumsum(counts) - counts
    lengths = np.fromiter((len(pieces(w)) for w in words), np.int64, len(words))
    buckets = np.fromiter(chain.from_iterable(map(pieces, words)), np.int32, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    held = rng.permutation(len(texts))
    aside, use = held[: len(texts) // 5], held[len(texts) // 5 :]
    state: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None, rate: float = 0.01) -> None:
        if name not in state:
            state[name] = [np.zeros_like(value), np.zeros_like(value)]
        m, v = state[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-7)

    for _ in range(epochs):
        order = rng.permutation(use)
        for batch in batched(order, counts):
            step += 1
            n = counts[batch]
            own = np.concatenate([which[begin[d] : begin[d] + m] for d, m in zip(batch, n)]) if n.sum() else np.zeros(0, np.int64)
            local, idx = np.unique(own, return_inverse=True)
            m = lengths[local]
            flat = ragged(buckets, starts[local], m)
            vectors = np.add.reduceat(model.embedding[flat], np.cumsum(m) - m, axis=0) if len(local) else np.zeros((0, DIMS), np.float32)
            keep = (rng.random((len(batch), len(WIDTHS) * FILTERS)) > 0.2) / np.float32(0.8)  # dropout
            top, convs = model.pooled(vectors, idx, n)
            z = (top * keep) @ model.out + model.out_bias
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)).astype(np.float32)
            d_top = (error[:, None] * model.out[None] * keep * (top > 0)).astype(np.float32)
            d_out = (top * keep).T @ error + 1e-5 * model.out
            d_vec = np.zeros_like(vectors)
            b0 = np.cumsum(n) - n
            some = np.flatnonzero(n)
            owner = np.repeat(np.arange(len(batch)), n)
            for f, (width, conv) in enumerate(zip(WIDTHS, convs)):
                d = d_top[:, f * FILTERS : (f + 1) * FILTERS]
                d_kernel = np.zeros_like(model.kernels[f])
                if len(some):
                    most = np.zeros((len(batch), FILTERS), np.float32)
                    most[some] = np.maximum.reduceat(conv, b0[some], axis=0)
                    at, column = np.nonzero((conv == most[owner]) & (d[owner] != 0))
                    _, first = np.unique(owner[at] * FILTERS + column, return_index=True)  # ties: the first place
                    at, column = at[first], column[first]
                    g = d[owner[at], column]
                    for k in range(width):
                        ok = at + k < b0[owner[at]] + n[owner[at]]
                        w, c, gk = idx[at[ok] + k], column[ok], g[ok][:, None]
                        np.add.at(d_kernel[k].T, c, gk * vectors[w])
                        np.add.at(d_vec, w, gk * model.kernels[f][k].T[c])
                adam(f"kernel{f}", model.kernels[f], d_kernel)
                adam(f"bias{f}", model.bias[f], d.sum(0))
            d_emb_rows, inverse = np.unique(flat, return_inverse=True)
            d_emb = np.zeros((len(d_emb_rows), DIMS), np.float32)
            np.add.at(d_emb, inverse, np.repeat(d_vec, m, axis=0))
            if len(flat):
                adam("embedding", model.embedding, d_emb, d_emb_rows)
            adam("out", model.out, d_out)
            model.out_bias = np.float32(model.out_bias - 0.05 * error.sum())
    p = model.raw(which, words, counts)
    model.forget()
    langs = languages(which, words, counts)
    overall = best_threshold(p[aside], labels[aside])
    for k in range(len(LANGUAGES)):
        mine = aside[langs[aside] == k]
        weight = min(np.count_nonzero(labels[mine] == 1), np.count_nonzero(labels[mine] == 0))
        own = best_threshold(p[mine], labels[mine]) if weight else overall
        model.thresholds[k] = (weight * own + SHRINK * overall) / (weight + SHRINK)
    return model


def best_threshold(p: np.ndarray, labels: np.ndarray, clean_weight: float = 9.0) -> float:
    """Threshold of least cost, at which an error on a clean text weighs ``clean_weight`` times one on a toxic text.

    The sample may hold as many toxic as clean texts, while in a corpus about
    one in ten is toxic.  Of equally good thresholds the middle one is taken.
    """
    grid = np.linspace(0.1, 0.9, 81)
    cost = np.array([((p < t) & (labels == 1)).sum() + clean_weight * ((p >= t) & (labels == 0)).sum() for t in grid])
    good = np.flatnonzero(cost == cost.min())
    return float(grid[good[len(good) // 2]])


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id: str, text: str, label: str, most: int) -> DataFrame:
    """(h, id, t, y): up to ``most`` labelled rows of each label, whole, chosen by a hash of the id.

    A document labelled both ways is taken for either; of rows with one id, as many as fit.
    """
    known = labels.filter(F.col(label).isin(0, 1) & learn).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).dropna().distinct()
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    rows = texts.join(F.broadcast(first[0].unionByName(first[1])), "id").withColumn("h", F.xxhash64("id"))  # at most 2 * most ids
    taken = [rows.filter(F.col("y") == y).orderBy("h", "id", F.xxhash64("t"), "t").limit(most) for y in (0, 1)]
    return taken[0].unionByName(taken[1]).select("h", "id", "t", "y")


def fitted(sampled: DataFrame, chars: int = SAMPLE_CHARS) -> Model:
    """The model trained on the sample by one task.  Each label takes up to half of ``chars``; rows beyond it, in the order of the hash, are left out whole."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, room = [], [], [chars // 2, chars // 2]
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if room[y] > 0:
                    texts.append(t), labels.append(y)
                    room[y] -= len(t)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(labels, np.float32)))], pa.binary())], names=["model"])

    ordered = sampled.repartition(1).sortWithinPartitions("h", "id", "t").select("t", "y")  # bounded by the sample
    scratch = Scratch(sampled.sparkSession, "toxicity")
    rows = scratch.write(ordered.mapInArrow(learn, "model binary"), "model").collect()
    scratch.drop()
    return pickle.loads(rows[0]["model"]) if rows else train([], np.zeros(0, np.float32))


def score(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE, into: str = "score") -> DataFrame:
    """The rows with a column ``into``, the score from 0 to 1.

    ``learn`` is a condition on the labels' id: rows that may be learned from.
    The score depends on the text alone.  Null and empty texts score like a
    text in which no filter fires.  Rows alike score alike.  Without labelled
    rows, or with one label only, all texts have one and the same score on that
    label's side (none: near 0).  An empty table gives an empty result.
    """
    importable(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample(docs, labels, learn, id, text, label, most)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 1024):
                part = batch.slice(lo, 1024)
                p = model.value.scores(part.column(text).to_pylist()) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, into])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField(into, DoubleType())]))
