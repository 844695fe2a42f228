"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on text labelled good, one on text labelled bad.  A
text is compressed with both, in blocks of ``BLOCK`` bytes, so that the
dictionaries and not the text's own beginning explain each block; all blocks of
the whole text count.  The difference of the two compressed sizes over the
size of the text is bent to a score by a logistic curve, which is fitted on
labelled texts that the dictionaries have not seen and weighs each label as
often as it occurs; differences far from the border are cut off first, so that
the curve is fitted where it decides.  A text that repeats itself is short under both
dictionaries, so its difference is near zero, where clean text has not been
seen.  Very short texts tell little: ``PRIOR`` bytes of usual good text are
added to each.

Training reads a bounded sample of labelled rows in one task; the driver sees
the two dictionaries and three numbers only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, importable, spare
from .toxicity import sample

#: Bounds of the training sample: rows of each label, and characters of all of them.  Whole rows are left out, none is cut.
SAMPLE = 2000
SAMPLE_CHARS = 12_000_000
#: Bytes of a block, and of each dictionary at most.
BLOCK = 256
DICTIONARY = 400_000
LEVEL = 3
#: Bytes of usual good text that each text gets.
PRIOR = 20
#: Of the sample, one text in ASIDE is left for the curve.
ASIDE = 4
SEED = 12


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Model:
    """Two dictionaries (bad, good) and the curve; without dictionaries all texts score ``flat``."""

    def __init__(self, dictionaries: list[tuple[bytes, bool]], flat: float = 0.5):
        self.dictionaries, self.flat = dictionaries, flat
        self.slope, self.offset, self.usual = 0.0, 0.0, 0.0
        self.tools: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tools": None}

    def compressors(self) -> list:
        if self.tools is None:
            self.tools = []
            for data, plain in self.dictionaries:
                known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if plain else zstandard.DICT_TYPE_FULLDICT)
                known.precompute_compress(level=LEVEL)
                self.tools.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self.tools

    def difference(self, text: str | None) -> tuple[int, int]:
        """Compressed bytes under the bad dictionary less those under the good one, and bytes of the text."""
        data = (text or "").encode("utf-8", "replace")
        parts = blocks(data)
        bad, good = (sum(len(c.compress(p)) for p in parts) for c in self.compressors())
        return bad - good, len(data)

    def normalised(self, texts: list[str | None]) -> np.ndarray:
        d, n = np.array([self.difference(t) for t in texts], float).reshape(-1, 2).T
        span = max(abs(self.usual), 1e-3)
        return np.clip((d + PRIOR * self.usual) / (n + PRIOR), -span / 2, span)  # beyond these all is bad, or good

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.dictionaries:
            return np.full(len(texts), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.normalised(texts) + self.offset, -30, 30)))


def dictionary(texts: list[str]) -> tuple[bytes, bool]:
    """A dictionary of texts, and whether it is their plain bytes, as it is where they are too few to train on."""
    parts = [b for t in texts for b in blocks(t.encode("utf-8", "replace"))]
    total = sum(map(len, parts))
    if len(parts) >= 64 and total >= 16_384:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, total // 2), parts).as_bytes(), False
        except zstandard.ZstdError:  # texts without parts in common
            pass
    return b"".join(parts)[:DICTIONARY] or b" " * 8, True


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by Newton's method on the standardised x."""
    middle, spread = x.mean(), max(x.std(), 1e-9)
    z = np.stack([(x - middle) / spread, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge * weight.sum() * beta * [1, 0]
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * weight.sum() * np.diag([1.0, 1e-6])
        beta += np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(beta[0] / spread), float(beta[1] - beta[0] * middle / spread)


def train(texts: list[str], labels: np.ndarray, share: float = 0.5, seed: int = SEED) -> Model:
    """The model; ``share`` is how often label 1 occurs among labelled rows."""
    if not len(texts) or labels.min() == labels.max():
        return Model([], share if len(texts) else 0.5)
    aside = np.zeros(len(texts), bool)
    rng = np.random.default_rng(seed)
    for y in (0, 1):
        mine = rng.permutation(np.flatnonzero(labels == y))
        aside[mine[: len(mine) // ASIDE]] = True
    model = Model([dictionary([t for t, a, b in zip(texts, labels, aside) if a == y and not b]) for y in (0, 1)])
    tried = aside if len(set(labels[aside])) == 2 else np.ones(len(texts), bool)  # too few to leave some of either label aside
    held, y = [t for t, b in zip(texts, tried) if b], labels[tried].astype(float)
    d, n = np.array([model.difference(t) for t in held], float).T
    good = (y == 1) & (n > 0)
    model.usual = float(np.median(d[good] / n[good])) if good.any() else 0.0
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.slope, model.offset = curve(model.normalised(held), y, weight)
    return model


def fitted(sampled: DataFrame, share: float, chars: int = SAMPLE_CHARS) -> Model:
    """The model trained on the sample by one task.  Each label takes up to half of ``chars``; rows beyond it, in the order of the hash, are left out whole."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, room = [], [], [chars // 2, chars // 2]
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                if room[y] > 0:
                    texts.append(t.as_py()), labels.append(y)
                    room[y] -= len(texts[-1])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(labels), share))], pa.binary())], names=["model"])

    ordered = sampled.repartition(1).sortWithinPartitions("h", "id", "t").select("t", "y")  # bounded by the sample
    scratch = Scratch(sampled.sparkSession, "compression")
    rows = scratch.write(ordered.mapInArrow(learn, "model binary"), "model").collect()
    scratch.drop()
    return pickle.loads(rows[0]["model"]) if rows else train([], np.zeros(0))


def score(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE, into: str = "score") -> DataFrame:
    """The rows with a column ``into``, the score from 0 to 1; a column of that name is replaced.

    ``learn`` is a condition on the labels' id: rows that may be learned from.
    The score depends on the text alone.  Null and empty texts score like usual
    good text, of which they hold nothing but the prior.  Rows alike score
    alike.  With one label only all texts score that label, without labelled
    rows 0.5.  Labels other than 0 and 1 are not learned from.  An empty table
    gives an empty result.
    """
    importable(docs.sparkSession)
    counts = {r[0]: r[1] for r in labels.filter(F.col(label).isin(0, 1) & learn).groupBy(F.col(label).cast("int")).count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample(docs, labels, learn, id, text, label, most), share))
    named = spare("score", docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 1024):
                part = batch.slice(lo, 1024)
                p = model.value.scores([t.as_py() for t in part.column(text)]) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, named])

    out = docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField(named, DoubleType())]))
    return out.drop(*[c for c in docs.columns if c.lower() == into.lower()]).withColumnRenamed(named, into)
