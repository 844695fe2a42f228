"""Token ids of whole texts with the tokenizers library, with a memo of words.

The word-level BPE of the vocabulary never merges across white space, and its
normalizer and splitter treat a blank or line feed as a mere separator.  So the
ids of a text are the ids of its blank-separated parts in turn, and each worker
has to encode a part once.  ``tests/llm`` holds this against whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts kept by each Python worker; above it only parts that recur in a chunk are kept, up to twice as many.
MEMO = 300_000
#: Characters of one chunk, which bounds a worker's arrays.
CHUNK_CHARS = 4_000_000
#: Sentence stops: behind a letter, the splitter always parts them from it.
STOPS = (".", ",")
#: Below this code point a character is its own NFC form and has a lower case that no neighbour changes.
PLAIN = "\u0130"
#: A control character that the vocabulary has as one id; it parts the words of one encode call.
MARK = "\x01"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids() of many texts at once, as one flat array and a length for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, ord(PLAIN))}
        self.at: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of parts.

        Lower-case letters alone are one piece to the splitter, so they go to
        the model as they are; other parts are joined around a mark for fewer
        calls.
        """
        letters = [p for p in parts if p.isalpha() and p.islower() and (p.isascii() or max(p) < PLAIN)]
        if len(letters) < len(parts):
            own = set(letters)
            other = [p for p in parts if p not in own]
            flat, length = self._letters(letters)
            more, lengths = self._joined(other)
            at = dict(zip([*letters, *other], range(len(parts))))
            start, n = np.concatenate([np.cumsum(length) - length, len(flat) + np.cumsum(lengths) - lengths]), np.concatenate([length, lengths])
            order = np.fromiter(map(at.__getitem__, parts), np.int64, len(parts))
            return ragged(np.concatenate([flat, more]), start[order], n[order]), n[order]
        return self._letters(letters)

    def _letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [[t.id for t in self.model.tokenize(p if p.isascii() else p.translate(self.bytes))] for p in parts]
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(n.sum())), n

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(parts), 5000):
            some = parts[lo : lo + 5000]
            joined = f" {MARK} ".join(some)
            ids = np.array(self.encode([joined])[0] if len(self.mark) == 1 else [], np.uint32)
            cuts = ids == self.mark[0]
            if joined.count(MARK) == len(some) - 1 == np.count_nonzero(cuts):
                flats.append(ids[~cuts])
                lengths.append(np.diff(np.flatnonzero(cuts), prepend=-1, append=len(ids)) - 1)
            else:
                each = self.encode(some)
                flats += [np.array(x, np.uint32) for x in each]
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flats), np.concatenate(lengths)

    def learn(self, parts: list[str]) -> None:
        """Add parts to the memo, in this order.  A stop behind a letter is a token of its own, so it is set apart first."""
        stems = [p[:-1] if p[-1:] in STOPS and p[-2:-1].isalpha() else p for p in parts]
        order = {p: k for k, p in enumerate(dict.fromkeys([*STOPS, *stems]))}
        flat, length = self.encode_parts(list(order))
        start = np.cumsum(length) - length
        stem = np.fromiter(map(order.__getitem__, stems), np.int64, len(stems))
        stop = np.fromiter((order[p[-1]] if len(p) > len(x) else -1 for p, x in zip(parts, stems)), np.int64, len(parts))
        n = length[stem]
        pairs = np.stack([n, np.where(stop >= 0, length[stop], 0)], 1).ravel()
        self.flat = np.concatenate([self.flat, ragged(flat, np.stack([start[stem], start[stop]], 1).ravel(), pairs)])
        self.length = np.concatenate([self.length, pairs.reshape(-1, 2).sum(1)])
        self.start = np.cumsum(self.length) - self.length
        self.at.update(zip(parts, range(len(self.at), len(self.at) + len(parts))))

    def forget(self, parts: list[str], keep: int) -> None:
        """Take parts, which are all entries beyond the first ``keep``, out of the memo."""
        for p in parts:
            del self.at[p]
        self.flat, self.start, self.length = self.flat[: self.start[keep]], self.start[:keep], self.length[:keep]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of each."""
        flats, lengths, some, size = [], [], [], 0
        for text in texts:
            if text.isascii() or max(text) < PLAIN:
                text = text.lower()  # the normalizer's only effect on such a text, but for white space
            some.append(text.replace("\n", " "))
            size += len(text)
            if size >= CHUNK_CHARS:
                for x, out in zip(self._chunk(some), (flats, lengths)):
                    out.append(x)
                some, size = [], 0
        for x, out in zip(self._chunk(some), (flats, lengths)):
            out.append(x)
        return np.concatenate(flats), np.concatenate(lengths)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        which, parts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        where = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        known, missing = len(self.at), np.flatnonzero(where < 0)
        missing = missing[np.argsort(-np.bincount(which, minlength=len(parts))[missing], kind="stable")]  # those that recur come first
        recur = int(np.count_nonzero(np.bincount(which, minlength=len(parts))[missing] > 1))
        keep = known + max(min(max(0, MEMO - known), len(missing)), min(max(0, 2 * MEMO - known), recur))
        new = [parts[k] for k in missing.tolist()]
        self.learn(new)
        where[missing] = np.arange(known, known + len(new))
        entry = where[which]
        n = self.length[entry]
        ids = ragged(self.flat, self.start[entry], n)
        bounds = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py() if len(texts) else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate([[0], np.cumsum(n)])[bounds], prepend=0)
        if keep < len(self.at):
            self.forget(new[keep - known :], keep)
        return ids, lengths


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of a flat array, one after the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


#: One encoder for each Python worker and vocabulary; workers are reused from task to task.
_encoders: dict[str, Encoder] = {}


def documents_ids(path: str, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
    """Ids of each text (null: empty) with the end id behind, as unsigned 32-bit integers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    for lo in range(0, len(texts), 2048):
        some = [t or "" for t in texts[lo : lo + 2048]]
        flat, lengths = _encoders[path].ids(some)
        at = 0
        for n in lengths.tolist():
            yield np.append(flat[at : at + n], np.uint32(end))
            at += n
