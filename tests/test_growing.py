"""Stored blocking keys, growing components and near texts against plain Python."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewater.operators import components, near_text
from tidewater.operators.dedup_index import KeyIndex
from tidewater.storage import Scratch

KEYED = "id int, keys array<struct<kind:string,key:string>>"


def pairs_of(rows, changed):
    blocks = defaultdict(set)
    for i, keys in rows.items():
        for k in keys:
            blocks[k].add(i)
    return {(a, b) for ids in blocks.values() for a, b in combinations(sorted(ids), 2) if a in changed or b in changed}


def test_index_follows_changes_and_reads_touched_buckets(spark, tmp_path):
    rng = random.Random(5)
    draw = lambda: [("k", str(rng.randrange(40))) for _ in range(rng.randrange(3))]
    rows = {i: draw() for i in range(120)}
    index = KeyIndex.create(spark, f"{tmp_path}/x", spark.createDataFrame(list(rows.items()), KEYED), buckets=16)
    got = lambda ix, ids: set(map(tuple, ix.candidates(spark.createDataFrame([(i,) for i in ids], "id int")).collect()))
    assert got(index, range(120)) == pairs_of(rows, set(range(120)))
    for turn in range(3):
        changed = {i: draw() for i in rng.sample(range(150), 4)}
        gone = [i for i in rng.sample(range(120), 3) if i not in changed]
        rows.update(changed)
        for i in gone:
            rows.pop(i, None)
        written = index.refresh(spark.createDataFrame(list(changed.items()), KEYED), spark.createDataFrame([(i,) for i in gone] or [(999,)], "id int"))
        assert 0 < written["records"] <= 7 and written["keys"] < 16
        again = KeyIndex(spark, f"{tmp_path}/x")
        assert again.number == turn + 1 and got(again, changed) == pairs_of(rows, set(changed))
        assert {(r["kind"], r["key"], r["id"]) for r in again.keys().collect()} == {(*k, i) for i, keys in rows.items() for k in keys}
    one = again.candidates(spark.createDataFrame([(next(iter(changed)),)], "id int"))
    assert len(one.inputFiles()) < len(again.keys().inputFiles()) + len(again.records().inputFiles())
    index.refresh(spark.createDataFrame([], KEYED), again.records().select("id"))
    assert index.keys().count() == index.records().count() == 0 and got(index, [1]) == set()


def plain_labels(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_merging_is_the_same_as_recomputing(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = [(u, v) for u, v in edges if u != v]
    df = lambda rows: spark.createDataFrame(rows, "u int, v int")
    for cut in (0, 10, 30, len(edges)):
        known = Scratch(spark, "t").write(components.labels(df(edges[:cut]), Scratch(spark, "t")), "known")
        every, changed = components.merged(known, df(edges[cut:] + [(3, 3)]), Scratch(spark, "t"))
        old, new = plain_labels(edges[:cut]), plain_labels(edges)
        assert dict(map(tuple, every.collect())) == new
        assert {n for n, _ in changed.collect()} >= {n for n in new if old.get(n) != new[n]}
        assert {n for n, _ in changed.collect()} <= {n for n in new if n not in old or old[n] in {o for o in old.values() if new[o] != o}}
    known = Scratch(spark, "t").write(components.labels(df(edges), Scratch(spark, "t")), "known")
    left = edges[:25]
    touched = spark.createDataFrame([(x,) for e in edges[25:] if e not in left for x in e], "node int")
    assert dict(map(tuple, components.recomputed(known, df(left), touched, Scratch(spark, "t"))[0].collect())) == plain_labels(left)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold,long", [(0.85, 120), (0.7, 120), (0.85, 15), (1.0, 120)])
def test_near_texts_lose_no_pair(spark, monkeypatch, threshold, long):
    monkeypatch.setattr(near_text, "LONG", long)
    rng = random.Random(11)
    words = ["acme works", "acme ", "b", "", "ab", "consolidated acme works of the north", "x" * 30]
    rows = []
    for i in range(150):
        t = rng.choice(words) + " " + str(rng.randrange(120))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(t) + 1)
            t = rng.choice([t[:p] + t[p + 1 :], t[:p] + "q" + t[p:], t[:p] + "z" + t[p + 1 :]])
        rows.append((i, rng.choice([t, t, t, words[i % 7]]), f"b{i % 2}"))
    rows += [(900, None, "b0"), (901, "x", None), (None, "x", "b0"), (902, "", "b0"), (903, "", "b0"), (904, "Ünï😀codé text", "b0"), (905, "Ünï😀codé texT", "b0")]
    df = spark.createDataFrame(rows, "id int, text string, block string").repartition(3)
    classes, pairs = near_text.near_texts(df, threshold, block="block")
    first = {}
    for i, t, b in sorted((r for r in rows if None not in r), key=lambda r: r[0]):
        first.setdefault((b, t), i)
    assert dict(map(tuple, classes.collect())) == {i: first[b, t] for i, t, b in rows if None not in (i, t, b)}
    want = {}
    for (b1, t1), (b2, t2) in combinations(first, 2):
        sim = 1 - distance(t1, t2) / max(len(t1), len(t2), 1)
        if b1 == b2 and t1 and t2 and sim >= threshold - 1e-12:
            want[tuple(sorted((first[b1, t1], first[b2, t2])))] = round(sim, 9)
    assert {(a, b): round(s, 9) for a, b, s in pairs.collect()} == want


def test_a_crowded_block_makes_few_candidates(spark, monkeypatch):
    """1,500 names that differ in their last digits: what meets stays near what is similar."""
    met = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: met.append(out := write(self, df, name)) or out)
    rows = spark.createDataFrame([(i, f"consolidated works {i:05d}") for i in range(1500)], "id int, text string")
    found = near_text.near_texts(rows, 0.95)[1].count()
    assert found == sum(sum(x != y for x, y in zip(f"{a:05d}", f"{b:05d}")) <= 1 for a, b in combinations(range(1500), 2))
    assert met[-1].count() < 4 * found


def test_crowded_blocks_are_compared_in_tiles(spark, monkeypatch):
    """Names of one beginning and end with three edits: none meet by keys, and no pair is lost across chunks, lengths or long texts."""
    from tidewater.operators import near_tiles

    monkeypatch.setattr(near_text, "CROWD", 40)
    monkeypatch.setattr(near_tiles, "CHUNK", 50)
    monkeypatch.setattr(near_tiles, "BATCH", 100)
    monkeypatch.setattr(near_text, "LONG", 30)
    met = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: met.append((name, out := write(self, df, name))) or out)
    names = sorted({f"acme works {i * 37 % 5000} inc." for i in range(130)} | {f"acme works of the north {i * 91}" + " and sons" * (i % 2) for i in range(60)} | {"", "acme"})
    rows = [(f"c{i:04d}", t, b) for i, (t, b) in enumerate((t, b) for b in ("x", "y") for t in names[: 200 if b == "x" else 30])] + [("c9999", names[5], "x")]
    pairs = near_text.near_texts(spark.createDataFrame(rows, "id string, text string, block string"), block="block")[1].collect()
    want = {}
    for (i, t, b), (j, u, c) in combinations(rows[:-1], 2):
        if b == c and t and u and 1 - distance(t, u) / max(len(t), len(u)) >= 0.85 - 1e-12:
            want[i, j] = round(1 - distance(t, u) / max(len(t), len(u)), 9)
    assert {(a, b): round(s, 9) for a, b, s in pairs} == want and len(pairs) == len(want)
    held = dict(met)
    assert [r["block"] for r in held["crowded"].collect()] == ["x"] and held["chunks"].count() > 2
    assert max(len(rows[int(r["a"][1:])][1]) for r in pairs) > 30


def test_index_makes_keys_once(spark, tmp_path):
    """Keys may be dear: creating an index and refreshing it make those of each record once."""
    made = spark.sparkContext.accumulator(0)

    def keys(i):
        made.add(1)
        return [("k", str(i % 7))]

    kind = "array<struct<kind:string,key:string>>"
    keyed = lambda n: spark.range(n).select(F.col("id"), F.udf(keys, kind)("id").alias("keys"))
    index = KeyIndex.create(spark, f"{tmp_path}/once", keyed(60), buckets=4)
    assert made.value == 60
    index.refresh(keyed(9))
    assert made.value == 69
    assert index.candidates(spark.range(1)).count() == 8


def test_names_of_few_edits_are_found_by_their_tries(monkeypatch):
    """Every pair once, with its distance, whatever is made at once; no text of few edits is compared with all others."""
    import numpy as np

    from tidewater.operators import near_tiles, near_tries

    rng = random.Random(3)
    rows = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
    for trial in range(60):
        monkeypatch.setattr(near_tries, "SLICE", rng.choice([7, 50, 1 << 18]))
        monkeypatch.setattr(near_tries, "TABLES", rng.choice([100, 1 << 26]))
        m, k, letters, end = rng.randrange(1, 9), rng.randrange(5), rng.choice(["ab", "abcd", "é😀ab"]), rng.choice(["", " inc"])
        lot = lambda n: sorted({"xy" + "".join(rng.choices(letters, k=n)) + end for _ in range(rng.choice([3, 40, 300]))})
        x, y = lot(m), lot(max(1, m + rng.randrange(-2, 3)))
        for y, same in ((y, False), (x, True)):
            got = [(i, j, d) for u, v, far in near_tries.near(rows(x), rows(y), k, same) for i, j, d in zip(u.tolist(), v.tolist(), far.tolist())]
            want = {(i, j, d) for i, a in enumerate(x) for j, b in enumerate(y) if (i < j or not same) and (d := distance(a, b)) <= k}
            assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.undo()
    monkeypatch.setattr(near_tiles, "near", None)
    names = [f"acme works {i:06d} inc." for i in range(0, 60000, 7)]
    found = sum(len(s) for _, _, s in near_tiles._similar(names[:4000], names[4000:], 0.85, False))
    assert found == sum(len(d) for _, _, d in near_tries.near(rows(names[:4000]), rows(names[4000:]), 3)) > 0
    assert max(1 - s.min() for _, _, s in near_tiles._similar(names, names, 0.85, True)) == pytest.approx(3 / 22)
