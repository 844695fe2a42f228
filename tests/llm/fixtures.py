"""Texts and tables that every operator must take."""

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "Same Text here now"), (7, "same text HERE now"), (8, "same text HERE now"),
    (8, "same text HERE now"), (None, "no id here at all"), (None, None), (9, "\U0001f600 ünḯ côdé " * 20), (10, "long " * 30_000), (11, "x" * 100_000), (12, "a b c d e f g\n" * 50),
]
CLASH = "size int, fp int, key int, score int, kept int, c int, h int, v int, n int, spans int, __x int"


def odd(spark):
    """The odd texts as documents with extra columns, some with names that operators use themselves."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    rows = [(k, t, "en" if i % 2 else None, [None, "a", "b", "a"][i % 4], None if t is None else len(t), *[7] * len(names)) for i, (k, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}").repartition(3)


def empty(spark):
    return odd(spark).filter("1 = 0")


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
