import numpy as np
import pytest

from tidewater.llm import neighbours


def brute(rows, k, every):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        others = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        yield int(ids[i]), [(int(ids[j]), s[j]) for j in others]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = found(neighbours.search(table, lambda id: id % 20 == 0))
    hit = total = 0
    for q, want in brute(rows, 20, 20):
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hit += len({v for v, _ in got[q]} & {v for v, _ in want})
        total += len(want)
    assert hit / total >= 0.9
    scored = [r["scored"] for r in neighbours.search(table, lambda id: id % 20 == 0, counted=True).collect()]
    print(f"recall {hit / total:.4f}, compared with {np.mean(scored) / len(rows):.3f} of all rows")
    assert np.mean(scored) < 0.42 * len(rows)  # vectors of no structure, so few that the 20th of 2,000 is hardly near


def test_copies_ties_norms_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 3)).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 0.5, 0.0, -1.0, 3.0]) for i in range(60, 160)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] + [1.0] * 5), (300, [1.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows + rows[:3] + bad, "vec_id bigint, embedding array<double>").repartition(3)
    got = found(neighbours.search(table, lambda id: id % 20 == 0, k=20))
    assert set(got) == {q for q, _ in brute(rows, 20, 20)}
    for q, want in brute(rows, 20, 20):
        assert len(got[q]) == 20 and q not in [v for v, _ in got[q]]
        if q >= 60:  # a hundred copies: the smallest ids
            top = [v for v, s in want if s == want[0][1]]
            assert [v for v, _ in got[q]][: len(top)] == top


def test_few_and_no_rows(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert found(neighbours.search(some, lambda id: id == 0, k=20)) == {0: [(1, 0.5), (2, 0.0)]}
    assert neighbours.search(some.limit(0), lambda id: id == 0).count() == 0
    assert neighbours.search(some, lambda id: id == 7).count() == 0


def test_probes_come_in_the_order_of_their_chances():
    model = neighbours.Model(4, 1.0, 5)
    projected = np.random.default_rng(1).normal(size=(3, neighbours.TABLES * 5))
    costs = model.costs(projected, 1)
    every = np.array(np.meshgrid(*[range(neighbours.CELLS)] * 5, indexing="ij")).reshape(5, -1)
    for q in range(3):
        total = sum(costs[q, d][every[d]] for d in range(5))
        numbers = sum(every[d] * neighbours.CELLS ** (4 - d) for d in range(5))
        got = model.probes(projected, 1, 40)[q]
        assert len(set(got.tolist())) == 40
        cost = dict(zip(numbers.tolist(), total.tolist()))
        assert [cost[b] for b in got.tolist()] == pytest.approx(sorted(total.tolist())[:40])


def test_groups_are_prefixes_and_ids_need_not_be_numbers(spark, monkeypatch):
    """Small blocks: many groups, of which a query visits its own; ids are strings."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(f"v{i:04d}", (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = found(neighbours.search(table, lambda id: id.endswith("0"), k=5))
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    hit = 0
    for q in range(0, 600, 10):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({v for v, _ in got[f"v{q:04d}"]} & {f"v{j:04d}" for j in np.argsort(-s)[:5]})
    assert len(got) == 60 and hit / 300 >= 0.9


def test_best_of_a_sample_copies_only_what_it_keeps():
    import tracemalloc

    rng = np.random.default_rng(2)
    queries, rows = rng.normal(size=(256, 64)), rng.normal(size=(30_000, 64))
    score, held = np.zeros((256, 0)), np.zeros((256, 0, 64))
    tracemalloc.start()
    for lo in range(0, len(rows), 2048):
        score, held = neighbours._kept(score, held, queries @ rows[lo : lo + 2048].T, rows[lo : lo + 2048], 21)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    want = np.sort(queries @ rows.T, axis=1)[:, ::-1][:, :21]
    assert np.allclose(score, want) and np.allclose(np.einsum("qd,qkd->qk", queries, held), want)
