import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidewater.llm import simhash

from .fixtures import docs, empty, odd


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def near(a, b):
    return (a ^ b).bit_count() <= 2


def check(rows, got):
    fps = [fingerprint(t) for _, t in rows]
    roots = components(fps, near)
    least = defaultdict(list)
    for (k, _), r in zip(rows, roots):
        if k is not None:
            least[r].append(k)
    want = sorted((str(k), f"{f:016x}", min(least[r], default=None)) for (k, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_against_brute_force(spark, sf):
    table = docs(spark, sf)
    check([(r["doc_id"], r["text"]) for r in table.collect()], simhash.near_duplicates(table).collect())


def test_odd_texts(spark):
    check([(r["doc_id"], r["text"]) for r in odd(spark).collect()], simhash.near_duplicates(odd(spark)).collect())
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("words", [1, 2])
def test_close_pairs_against_all_pairs(words):
    rng = np.random.default_rng(words)
    fps = rng.integers(0, 2**64, (300, words), np.uint64)
    fps[150:] = fps[:150] ^ (np.uint64(1) << rng.integers(0, 64, (150, words), np.uint64))
    fps[200:] ^= np.uint64(1) << rng.integers(0, 64, (100, words), np.uint64)
    groups, label = np.repeat([0, 1, 2], [200, 0, 100]), rng.integers(0, 40, 300)
    for radius in (2, 5, 20):
        got = {(int(a), int(b)) for x, y in simhash.close_pairs(groups, fps, label, radius) for a, b in zip(x, y)}
        want = {(a, b) for b in range(300) for a in range(b) if groups[a] == groups[b] and label[a] != label[b] and int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= radius}
        assert got == want


@pytest.mark.parametrize("group", [4, 512])
def test_hot_groups_are_dealt_by_more_bits(spark, monkeypatch, group):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 3)
    fps = {int(b) ^ int(x) for b in base for x in (1 << rng.integers(0, 62, 60)) | (1 << rng.integers(0, 62, 60))}
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**62, 50)})
    monkeypatch.setattr(simhash, "GROUP", group)
    scratch = simhash.Scratch(spark, "test")
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    found = simhash.connected_components(simhash.links(table, scratch), scratch).collect()
    label = {r["node"]: r["root"] for r in found}
    roots = components(fps, near)
    groups = {}
    for f, r in zip(fps, roots):
        groups.setdefault(r, set()).add(label.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_long_chain(spark):
    scratch = simhash.Scratch(spark, "chain")
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    found = {r["node"]: r["root"] for r in simhash.connected_components(edges, scratch).collect()}
    assert {found.get(i, i) for i in range(61)} == {0} and found[101] == 100
