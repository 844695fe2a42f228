"""Quality rules, substring dedup and toxicity."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import quality, queries, substrings, toxicity

from .fixtures import ODD, docs, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    w = WORD.findall(t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, sf):
    extra = ["a b c " * 40, "p q r s " * 9 + "z", " ".join(f"w{i % 90}" for i in range(300)), "x x x x", "u v", "#*$%&|<> a\na\n a\n\n"]
    for table in (docs(spark, sf), odd(spark), spark.createDataFrame(list(enumerate(extra)), "doc_id bigint, text string")):
        for r in quality.assess(table).collect():
            n, chars, symbols, dup, rep = counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), r["doc_id"]
            assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["kept"] and r["base_failed"])
    assert quality.assess(empty(spark)).count() == 0


def test_quality_is_one_projection(spark, sf):
    plan = quality.assess(docs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_quality_verdict_follows_labels(spark, sf):
    joined = quality.assess(docs(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    right = joined.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def brute_repeats(rows, window):
    seen = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    for k, w in rows:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        yield str(k), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("window,gram,bound,part", [(35, 8, 500_000, 1000), (35, 8, 20, 100), (5, 2, 1, 50)])
def test_repeats_against_brute_force(spark, sf, monkeypatch, window, gram, bound, part):
    """Small chunks, groups and tasks: prefixes are lengthened, and tasks forget what they need not hold."""
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "BOUND", bound)
    run = " ".join(f"w{i}" for i in range(60))
    more = spark.createDataFrame([(-1, run), (-2, "x " + run[:190]), (-3, "same row " + run), (-3, "same row " + run), (-4, "b " * 34), (-5, "c " * 35), (-6, "c " * 36)], "doc_id bigint, text string")
    table = docs(spark, sf).select("doc_id", "text").unionByName(more).unionByName(odd(spark).filter("doc_id <> 10 or doc_id is null").select("doc_id", "text"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.remove_repeats(table, window, gram).collect())
    assert got == sorted(brute_repeats([(r["doc_id"], WORD.findall(r["text"] or "")) for r in table.collect()], window))
    assert sum(x[2] for x in got) > 0


@pytest.mark.parametrize("limit", [100_000, 0])
def test_repeats_are_compared_by_words(spark, monkeypatch, limit):
    """All hashes of windows collide, and heavy prefixes are told to the tasks or joined to the rows: only words decide."""
    for name, value in (("CHUNK", 100), ("PART", 40), ("BOUND", 5), ("BROADCAST_ROWS", limit)):
        monkeypatch.setattr(substrings, name, value)
    real = substrings.rolling
    collide = lambda x, lengths: [h if n == 2 else h * np.uint64(0) for n, h in zip(lengths, real(x, lengths))]
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "ab"], 30))) for k in range(60)]
    want = sorted(brute_repeats([(k, t.split()) for k, t in rows], 5))
    got = lambda: sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.remove_repeats(table, 5, 2).collect())
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got() == want
    chunk = substrings.Chunk([t for _, t in rows], 5, 2)
    monkeypatch.setattr(substrings, "rolling", collide)
    forced = substrings.Chunk([t for _, t in rows], 5, 2)
    assert len(np.unique(forced.hash)) == 1 and (forced.again == chunk.again).all() and (forced.send == chunk.send).all()
    held = substrings.Held()
    for b in forced.rows(np.arange(60), np.zeros(60, np.int64)):
        p, a, z, start, upto, words = (b.column(c) for c in range(6))
        own = upto.to_numpy() == 0
        held.add(substrings.from_column(p)[own], a.to_numpy()[own], z.to_numpy()[own], start.to_numpy()[own].astype(np.int64), np.zeros(own.sum(), bool), [w for w in words.to_pylist() if w], 5)
    assert held.size == forced.send.sum() and held.grow(5, last=True).num_rows == 0


def test_words_that_neighbours_share():
    rows = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [2, 2, 4]])
    assert substrings.shared_words(rows).tolist() == [3, 2, 0]


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_a_prefix_that_a_third_of_all_windows_share(spark, monkeypatch):
    """One 8-word passage in different surroundings: counted before anything moves, no group exceeds the bound by chance's share."""
    monkeypatch.setattr(substrings, "BOUND", 200)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(k, " ".join(f"a{k}x{i}" for i in range(20)) + f" {passage} " + " ".join(f"b{k}x{i}" for i in range(20))) for k in range(300)]
    table = spark.createDataFrame(rows, "a bigint, text string").select("a", F.lit(0).cast("bigint").alias("b"), "text").repartition(3)
    heavy, parts = substrings.in_order(substrings.heavy_prefixes(table, 35, 8, "text"))
    assert len(heavy) >= 1 and parts.max() >= 10
    chunk = next(substrings._chunks(iter(table.toArrow().to_batches()), 35, 8, 10**9))[0]
    whole = len(chunk.prefix)
    chunk.lengthen(heavy, parts)
    sizes = np.unique(chunk.prefix, return_counts=True)[1]
    assert whole > 6000 and sizes.max() <= 2 * 200
    assert substrings.repeated_spans(table).count() == 0


def test_first_least():
    x = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 28):
        assert substrings.first_least(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(200 - width + 1)]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    toxic, clean = [r["predicted"] for r in got if r["toxic"] == 1], [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.02


def test_toxicity_of_odd_texts_and_labels(spark):
    table = odd(spark)
    labels = spark.createDataFrame([(6, 1), (7, 0), (4, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity.score(table, labels, F.lit(True), into="__score").collect()
    assert len(out) == len(ODD) and all(0 <= r["__score"] <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r["text"] or "", r["__score"]) == r["__score"]
    one = toxicity.score(table, labels.filter("toxic = 0"), F.lit(True), into="__score").collect()
    assert {r["__score"] < 0.5 for r in one} == {True}
    assert toxicity.score(empty(spark), labels.limit(0), F.lit(True), into="__score").count() == 0


def test_score_needs_no_neighbours():
    model = toxicity.train(["you idiot", "kind words here", "idiot again", "good day to you"] * 5, np.array([1, 0, 1, 0] * 5, np.float32), epochs=3)
    texts = ["you idiot", "", "kind words here and more of them", "idiot", None]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_coding_in_parts_gives_the_same_words():
    from tidewater.llm.toxicity import CODE_TEXTS, coded, coded_in_parts

    texts = [None, "", "One, two one", "\t\n", "dós ONE"] * CODE_TEXTS
    which, words, counts = coded(texts)
    some, own, n = coded_in_parts(texts)
    assert [words[k] for k in which] == [own[k] for k in some]
    assert counts.tolist() == n.tolist()
    assert coded_in_parts([])[2].tolist() == []
