import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import toxicity


def late(rng, n, words=2500):
    """Texts in which toxic words come at the end, and clean ones."""
    labels = np.arange(n) % 2
    return [" ".join([*(f"plain{k}" for k in rng.integers(0, 60, words)), *(["you", "idiot"] if y else ["good", "day"])]) for y in labels], labels.astype(np.float32)


def test_words_beyond_the_first_2000_are_learned():
    rng = np.random.default_rng(8)
    model = toxicity.train(*late(rng, 120))
    texts, labels = late(rng, 20)
    assert ((model.scores(texts) >= 0.5) == (labels == 1)).all()


def test_sampled_texts_are_whole(spark):
    rows = [(k, " ".join(f"w{k}" for _ in range(3000)), k % 2) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    pick = lambda docs, most: toxicity.sample(docs, table.drop("text"), F.lit(True), "doc_id", "text", "toxic", most).collect()
    got = pick(table.drop("toxic"), 3000)
    assert sorted(r["t"] for r in got) == sorted(t for _, t, _ in rows) and sum(r["y"] for r in got) == 10
    got = pick(table.drop("toxic"), 4)
    assert len(got) == 8 and sum(r["y"] for r in got) == 4 and {r["t"] for r in got} <= {t for _, t, _ in rows}
    hot = table.drop("toxic").unionByName(table.drop("toxic").filter("doc_id = 3").withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("c"))
    assert sum(r["y"] for r in pick(hot, 30)) == 30  # repeated rows fill their label, not the other


def test_one_task_trains_what_the_driver_would(spark):
    rows = [(k, k, ("you idiot " if k % 2 else "good day ") * (5 + k), k % 2) for k in range(80)]
    model = toxicity.fitted(spark.createDataFrame(rows, "h bigint, id bigint, t string, y int").repartition(3))
    assert (model.scores([r[2] for r in rows]).round() == [r[3] for r in rows]).all()
    few = toxicity.fitted(spark.createDataFrame(rows, "h bigint, id bigint, t string, y int"), chars=1000)
    assert (few.scores([r[2] for r in rows]).round() == [r[3] for r in rows]).mean() > 0.5
    assert toxicity.fitted(spark.createDataFrame([], "h bigint, id bigint, t string, y int")).scores(["x"])[0] < 0.5


def test_scores_follow_the_network_as_written_out():
    """A slow forward pass: embeddings summed, each filter at each place, maxima, logistic, threshold."""
    model = toxicity.train(["you idiot here", "kind words here", "idiot again so", "good day to you"] * 6, np.array([1, 0, 1, 0] * 6, np.float32), epochs=3)
    for text in ("you idiot", "the kind and good day of words", "one", "", "idiot " * 7):
        vectors = [sum(model.embedding[b] for b in toxicity.pieces(w.encode())) for w in text.split()]
        top = []
        for width, kernel, bias in zip(toxicity.WIDTHS, model.kernels, model.bias):
            for f in range(toxicity.FILTERS):
                at = [sum(float(vectors[i + k] @ kernel[k, :, f]) for k in range(width) if i + k < len(vectors)) for i in range(len(vectors))]
                top.append(max(0.0, max(at) + float(bias[f])) if at else 0.0)
        p = 1 / (1 + np.exp(-(np.array(top) @ model.out + model.out_bias)))
        words = text.split()
        best = max(range(4), key=lambda k: sum(w in list(toxicity.FUNCTION_WORDS.values())[k] for w in words))
        lang = best if any(w in list(toxicity.FUNCTION_WORDS.values())[best] for w in words) else 4
        t = model.thresholds[lang]
        want = 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / (1 - t)
        assert abs(model.scores([text])[0] - want) < 1e-4


def test_batches_hold_whole_texts():
    counts = np.array([10, 250_000, 60_000, 60_000, *[5] * 100])
    parts = list(toxicity.batched(np.arange(len(counts)), counts))
    assert np.concatenate(parts).tolist() == list(range(len(counts)))
    assert all(len(p) == 1 or counts[p].sum() <= toxicity.BATCH_WORDS for p in parts) and max(map(len, parts)) <= 64
