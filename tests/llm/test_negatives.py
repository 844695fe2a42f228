"""Hard negatives against all pairs in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import negatives as N

SCHEMA = "vec_id bigint, label int, embedding array<double>, score int, c int, `key` int, near int, q int"


def brute(rows, every, positives=5, wanted=3):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) and abs(x) < N.LARGE for x in v)
    kept = sorted({(i, y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, y, v in rows if i is not None and y is not None and fine(v)})
    out = []
    for i, y, v in kept:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in kept if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            fits = sorted((n, k) for n, k, z in scored if z != y and 50 * -s <= 100 * -n <= 95 * -s)
            out += [(i, j, r, k, -s, -n) for r, (n, k) in enumerate(fits[:wanted], 1)]
    return sorted(out)


def run(spark, rows, every, parts=3, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, N.mine(df, lambda id: id % every == 0, **more).collect()))


def vectors(n, dims, seed, labels=4, scale=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, scale, (labels, dims))
    return [(int(i), int(i % labels), [float(x) for x in centre[(i * 7) % labels] * 0.7 + rng.normal(0, scale, dims)]) for i in range(n)]


def test_many_blocks_and_tiles(spark, monkeypatch):
    for name, value in (("LEAST", 40), ("MOST", 60), ("TILE", 16), ("AT_ONCE", 5)):
        monkeypatch.setattr(N, name, value)
    rows = vectors(400, 20, 1)
    assert run(spark, rows, 9) == brute(rows, 9)


def test_ties_copies_and_odd_rows(spark):
    rows = vectors(60, 9, 2) + [(100 + k, k % 3, [0.5] * 9) for k in range(40)]
    rows += [rows[0], rows[0], (0, 3, [0.1] * 9), (50, None, [0.1] * 9), (None, 1, [0.1] * 9), (200, 1, None), (202, 1, [None] * 9), (204, 2, [float("nan")] + [0.0] * 8)]
    rows += [(206, 2, [float("inf")] * 9), (208, 2, [1e6] * 9), (210, 1, []), (212, 1, [2.0, -3.0]), (214, 0, [0.0] * 9), (216, 1, [-300.0, 299.0] + [0.0] * 7)]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, rows, 2, positives=2, negatives=1) == brute(rows, 2, 2, 1)


def test_one_label_or_nothing(spark):
    rows = [(k, 1, [0.1 * k, 0.2]) for k in range(10)]
    assert run(spark, rows, 2) == []
    assert run(spark, [(1, 1, None)], 1) == []
    assert N.mine(spark.createDataFrame([], SCHEMA), lambda id: id % 2 == 0).collect() == []


@pytest.mark.parametrize("size", [3, 9, 200])
def test_bit_planes_give_exact_products(size):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    q = rng.integers(-(1 << 20), 1 << 20, (50, size))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(np.zeros(50, np.int64)), pa.array(q.tolist(), pa.list_(pa.int32()))], names=["id", "label", "q"])
    block = N.Block([batch], size, 21)
    a = rng.integers(-(1 << 20), 1 << 20, (4, size))
    which, row, product = block.pairs(a, np.full(4, -1), 0, 50, lambda low, high, i: np.ones(low.shape, bool))
    assert len(which) == 200 and (product == (a @ q.T)[which, row]).all()


def test_intervals_drop_pairs_before_the_last_plane():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    q = np.floor(256 * rng.normal(0, 0.125, (2000, 64))).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(np.zeros(2000, np.int64)), pa.array(q.tolist(), pa.list_(pa.int32()))], names=["id", "label", "q"])
    block, seen = N.Block([batch], 64, 9), []

    def possible(low, high, which):
        bar = np.sort((q[:8] @ q.T), axis=1)[:, -6]
        keep = high >= (bar[:, None] if which is None else bar[which])
        seen.append(int(keep.sum()))
        return keep

    block.pairs(q[:8], np.arange(8), 0, 2000, possible)
    assert seen == sorted(seen, reverse=True) and seen[-3] < seen[0] / 20


def test_whole_table_against_numpy(spark, sf):
    from tidewater.llm.queries import op11_negatives

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), "embedding").collect()
    assert sorted(map(tuple, op11_negatives(spark, sf).collect())) == brute(rows, 50)
