import re
from collections import defaultdict

import pytest

from tidewater.llm import mixing

from .fixtures import docs, empty, odd


def water_fill(sizes, weights, total, most):
    """By the letter of the contract: reshare the excess by weight until none is above its limit."""
    caps, fixed = {s: most * n for s, n in sizes.items()}, {}
    while True:
        free = [s for s in sizes if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[s] for s in free) if free else 0
        above = [s for s in free if level * weights[s] > caps[s]]
        if not above:
            return {**{s: level * weights[s] for s in free}, **fixed}
        fixed |= {s: caps[s] for s in above}


def test_targets_and_copies(spark, sf):
    rows = mixing.mix(docs(spark, sf)).collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert sum(r["copies"] * r["size"] for r in rows) == pytest.approx(sum(want.values()), rel=0.2)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs(spark, sf).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def test_odd_texts_and_names(spark):
    mixed = mixing.mix(odd(spark), prefix="__m_")
    assert mixed.count() == odd(spark).count()
    out = mixing.emit(mixed, prefix="__m_")
    assert out.columns == odd(spark).columns
    assert out.filter("size = 7").count() == out.count()
    assert mixing.emit(mixing.mix(empty(spark))).count() == 0


def test_source_beyond_the_broadcast_bound(spark, monkeypatch, sf):
    from tidewater.llm import common

    before = {r["doc_id"]: r["copies"] for r in mixing.mix(docs(spark, sf)).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(docs(spark, sf)).collect()} == before
