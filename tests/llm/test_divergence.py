"""Source divergences against plain Python with whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import divergence as D

from .fixtures import docs, empty, odd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(AZ) for w in TERM.findall(text or "")]
        counts[lang, source].update(words)
        seen[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for w, n in seen[lang].items() if n >= least)
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda n, N: 1 + 10**9 * (n + 1) // (N + len(kept))
        p = {s: {w: share(counts[lang, s][w], total[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w.decode(), -v, r) for r, (v, w) in enumerate(terms[:top], 1)]
    return sorted(out)


def rows_of(df):
    return [(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()]


def run(df, **more):
    return sorted(map(tuple, D.audit(df, **more).collect()))


def test_whole_table(spark, sf):
    df = docs(spark, sf)
    assert run(df) == brute(rows_of(df))


def test_many_blocks_ranges_and_pieces(spark, sf, monkeypatch):
    for name, value in (("TERMS", 50), ("SOURCES", 3), ("ENTRIES", 40), ("CHUNK_BYTES", 5000)):
        monkeypatch.setattr(D, name, value)
    df = docs(spark, sf).repartition(5)
    assert run(df, top=7) == brute(rows_of(df), top=7)


def test_odd_texts_sources_and_names(spark):
    df = odd(spark)
    assert run(df, least=1) == brute(rows_of(df), least=1)
    assert run(df) == brute(rows_of(df))
    assert run(empty(spark)) == []
    rows = [(None, None, "A b"), ("", "", "a B"), ("", "x", None), ("", "\U0001f600", "Éa éa a\x00b"), ("z", "only", "word " * 5), ("y", "a", None), ("y", "b", "12 34")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for least in (1, 2, 3):
        assert run(df, least=least) == brute(rows, least=least)


def test_terms_do_not_cross_documents():
    owner, term, n, docs_ = D.counted(pa.array(["ab", "cd ab", None, "", "AB"]), np.array([0, 0, 0, 0, 1]))
    assert sorted(zip(owner.tolist(), term.to_pylist(), n.tolist(), docs_.tolist())) == [(0, "ab", 2, 2), (0, "cd", 1, 1), (1, "ab", 1, 1)]


@pytest.mark.parametrize("modulus", [1, 2, 3])
def test_equal_hashes_of_different_bytes(modulus):
    words = [b"abc", b"abd", b"abc", b"ab", b"zzzz", b"abd", b"q", b"ab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    n = np.array(list(map(len, words)))
    start = np.cumsum(n) - n
    group, first = D.grouped(data, start, n, digest=lambda b: len(b) % modulus)
    assert [words[first[g]] for g in group] == words
    assert len(set(group.tolist())) == len(set(words))


def test_shares_are_exact():
    for n, total in ((0, 1), (10**14, 3 * 10**14), (7, 9 * 10**15), (9 * 10**15 - 2, 9 * 10**15 - 1)):
        assert D.share(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total
