import random

import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import copies

from .fixtures import docs, empty, odd


def sets(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_ids(rows):
    """Brute force: the least id of each component of texts whose five-word shingles overlap by 0.8."""
    parent, each = list(range(len(rows))), [sets(t) for _, t in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, s in enumerate(each):
        for x in s or {None}:
            holders.setdefault(x, []).append(k)
    for j, s in enumerate(each):
        for i in {i for x in s or {None} for i in holders[x] if i < j}:
            if not s or 5 * len(s & each[i]) >= 4 * len(s | each[i]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for k, (id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), id), id)
    return sorted(least.values())


def test_near_copies_go_and_others_stay(spark):
    sf = "/root/testdata/sf0.01"
    table = docs(spark, sf)
    want = kept_ids([(r["doc_id"], r["text"]) for r in table.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, table, sf).collect()) == want


@pytest.mark.parametrize(("turns", "block", "few"), [(0, 4096, 100), (0, 16, 3), (2, 16, 24), (3, 4096, 24)])
def test_chains_and_crowded_groups(spark, monkeypatch, turns, block, few):
    """Copies of one text with a few words changed, and a chain whose ends are not alike."""
    monkeypatch.setattr(copies, "TURNS", turns)
    monkeypatch.setattr(copies, "BLOCK", block)
    monkeypatch.setattr(copies, "FEW", few)
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(150), k % 4):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        chain[k * 16 : k * 16 + 6] = [f"y{k}"] * 6
        rows.append((100 + k, " ".join(chain)))
    rows += [(200 + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(80))) for k in range(20)]
    want = kept_ids(rows)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in copies.deduplicated(table).collect()) == want
    assert 20 < len(want) < 40


def test_odd_texts(spark):
    out = copies.deduplicated(odd(spark))
    assert out.columns == odd(spark).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [1, 4, 5, 6, None, 9, 10, 11, 12]))
    assert copies.deduplicated(empty(spark)).count() == 0


def test_sets_and_bands():
    hashes, n, same = copies.shingles(["a b c d e f", "", "A b", None, "a b c d e"])
    assert n.tolist() == [2, 0, 1, 0, 1] and same[1] == same[3] == 0
    assert hashes[0] == hashes[3] and len(np.unique(hashes)) == 3
    assert copies.band_keys(hashes, n).shape == (3, copies.BANDS) and copies.signatures(hashes, n).shape == (3, copies.WORDS)


@pytest.mark.parametrize("most", [1 << 26, 8])
def test_links_of_a_piece_against_all_pairs(most):
    """Texts around one, near and less near; bitmaps and merges give the same components as all pairs."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 100, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 100 - k % 30, replace=False), rng.integers(0, 2**63, k % 25, np.uint64)])) for k in range(120)]
    size = np.array(list(map(len, sets)))
    fps = copies.signatures(np.concatenate(sets), size).view(np.int64)
    root = np.where(np.arange(120) < 10, 0, np.arange(120))  # ten are one component already
    rows = np.column_stack([np.zeros(120, np.int64), np.zeros(120, np.int64), root, np.arange(120), size, fps])
    got = copies.links_of_piece(rows, np.concatenate(sets).view(np.int64), size, 0.8, most)
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    assert all(alike(a, b) for a, b in got.tolist()) and len(got) < 120

    def parts(links):
        label = list(range(120))
        for a, b in [*((0, k) for k in range(10)), *links]:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    bits = fps.view(np.uint64)
    want = [(a, b) for b in range(120) for a in range(b) if np.bitwise_count(bits[a] ^ bits[b]).sum() <= copies.RADIUS and alike(a, b)]
    assert parts(got.tolist()) == parts(want) and 1 < len(set(parts(want))) < 100


def test_radius_reaches_the_similarity():
    """Of sets of all sizes that overlap by 0.8, none lies beyond the radius."""
    rng = np.random.default_rng(9)
    for size in (4, 8, 16, 40, 200, 1000):
        far = []
        for _ in range(200):
            own = rng.integers(0, 2**63, size, np.uint64)
            other = own[: size * 8 // 9 + (size == 4) * 1]
            both = np.concatenate([own, other, rng.integers(0, 2**63, size - len(other), np.uint64)])
            x = copies.signatures(both, np.array([size, size]))
            far.append(int(np.bitwise_count(x[0] ^ x[1]).sum()))
        assert max(far) <= copies.RADIUS
