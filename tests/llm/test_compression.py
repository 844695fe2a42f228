"""The compression classifier on held-out labels and on odd tables."""

import numpy as np
import pytest

from tidewater.llm import compression as C
from tidewater.llm.queries import held_out, op12_compressed

from .fixtures import ODD, docs, empty, odd


def test_held_out_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = op12_compressed(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = (got.score[got.quality == y].to_numpy() for y in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (got.predicted == got.quality).mean() > 0.93 and (good >= 0.3).mean() > 0.97


def test_same_scores_again_and_none_from_the_id(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = {r["doc_id"]: r["score"] for r in C.score(docs(spark, sf), labels, ~held_out()).collect()}
    moved = docs(spark, sf).repartition(7)
    assert one == {r["doc_id"]: r["score"] for r in C.score(moved, labels, ~held_out()).collect()}
    assert all(0 <= s <= 1 for s in one.values())


def test_odd_texts_clashing_names_and_no_labels(spark, sf):
    df = odd(spark)
    known = df.sparkSession.createDataFrame([(k, k % 2) for k in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12)] + [(None, 1), (3, None), (3, 7)], "doc_id bigint, quality int")
    out = C.score(df, known, ~held_out())
    assert out.columns == [c for c in df.columns if c != "score"] + ["score"]
    got = out.select("doc_id", "text", "score").collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    for rows, expected in (([], 0.5), ([(1, 1), (2, 1), (4, 1)], 1.0), ([(1, 0), (2, 0), (4, 0)], 0.0)):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        assert {r["score"] for r in C.score(df, labels, held_out() | ~held_out()).select("score").collect()} == {expected}
    assert C.score(empty(spark), known, ~held_out()).collect() == []
    assert C.score(docs(spark, sf), known, ~held_out(), into="quality").columns[-1] == "quality"


def test_every_block_of_a_text_counts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    good = [" ".join(rng.choice(words, 200)) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 200)) for _ in range(80)]
    model = C.train(good + bad, np.array([1] * 80 + [0] * 80))
    clean, dirty = good[0] * 20, bad[0] * 20
    p = model.scores([clean, dirty, clean + dirty * 3, dirty * 3 + clean])
    assert p[0] > 0.9 > 0.1 > p[1]
    assert p[2] == pytest.approx(p[3], abs=0.1) and p[2] < p[0]


def test_curve_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x - 1)))).astype(float)
    slope, offset = C.curve(x, y, np.ones(4000))
    assert slope == pytest.approx(1.5, abs=0.15) and offset == pytest.approx(-1, abs=0.15)
