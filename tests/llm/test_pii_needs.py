import re

import pytest

from tidewater.llm import pii

from .fixtures import docs


@pytest.mark.parametrize("text", ["(243) 555-5526", "JOE [AT] X [DOT] COM"])
def test_whole_texts_without_zero_or_small_at(spark, text):
    table = spark.createDataFrame([(text,)], "text string")
    found = table.select(pii.candidates(table["text"]).alias("c")).first()["c"]
    assert [(x["s"], x["e"]) for x in found] == [(0, len(text))]


@pytest.mark.parametrize("kind", [k for k, need in enumerate(pii.NEEDS) if need])
def test_the_quick_test_skips_no_match(spark, sf, kind):
    table = docs(spark, sf)
    pattern = re.compile(pii.PATTERNS[kind].replace(r"\G|", ""))
    for r in table.collect():
        if m := pattern.search(r["text"] or ""):
            assert any(x in m[0] for x in pii.NEEDS[kind])
