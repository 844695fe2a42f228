"""Secrets: known patterns, and strings that a battery of randomness tests finds.

Texts are scanned where they lie.  A candidate is a run of 20 or more
characters of an encoding alphabet with at least one digit and one letter, so
letters alone or digits alone are never added.  Its encoding is
inferred, and three tests compare it with text that people write: chi-squared
uniformity over the alphabet, number of runs of character classes, and serial
correlation.  Fisher's method combines them to one statistic.

What the statistic is worth is calibrated on tokens that are natural by
construction: words and numbers of each document put together without blanks,
one for each thousand characters of every text.  A candidate's p-value is the
share of natural tokens of its class of length with as high a statistic; above
their 95th percentile an exponential tail is fitted.  False discoveries are
controlled by the Benjamini-Hochberg rule in each class of length, so that the
many short candidates do not decide about the long ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, importable

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Alphabets from the narrowest; a candidate has the first that holds all its characters.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("base32", "234567" + UPPER), ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER), ("base64", DIGITS + UPPER + LOWER + "+/"), ("base64url", DIGITS + UPPER + LOWER + "-_"),
)
#: False-discovery rate in each class of length, and the classes' upper ends.
RATE = 0.01
LENGTHS = (24, 32, 48, 64, 1 << 62)
#: One natural token for so many characters, and their lengths, one in each class.
STEP = 1000
NATURAL = (22, 30, 42, 58, 80)
#: How often natural tokens change the class of their characters, per step.
CHANGES = 0.15
#: Statistics are told apart on a grid of this many steps per unit.
GRID = 20
DIGIT, MARKS = re.compile("[0-9]"), re.compile("[^A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted.  Cheap searches come before the patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def long_words(text: str, least: int = 20) -> bool:
    """Whether any run of non-space characters is that long; only then can the run patterns match."""
    return any(len(w) >= least for w in text.split())


def encoding(s: str) -> tuple[str, str] | None:
    body = s.rstrip("=")
    if len(s) - len(body) > 2 or not (any(c in DIGITS for c in body) and any(c.isalpha() for c in body)):
        return None
    chars = set(body)
    return next((x for x in ALPHABETS if chars <= set(x[1])), None)


def classes(c: str) -> int:
    return 0 if c in DIGITS else 1 if c in LOWER else 2


def below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def statistic(s: str, alphabet: str, usage: dict[str, float]) -> int:
    """How random a string looks, on the grid: -log10 of what Fisher's method makes of the three tests.

    A string that one test alone finds natural has 0.
    usage: share of each character among those of all texts.
    """
    body = s.rstrip("=")
    n, k = len(body), len(alphabet)
    share = [usage.get(c, 0.0) + 1e-4 for c in alphabet]
    whole = sum(share)
    q = [x / whole for x in share]
    # chi-squared against uniform: natural text is far from it, so its statistic is high; low is random
    counts = [body.count(c) for c in alphabet]
    stat = sum((x - n / k) ** 2 for x in counts) * k / n
    square, cube = sum(x * x for x in q), sum(x**3 for x in q)
    mean = k * (1 + (n - 1) * square) - n
    spread = math.sqrt(max(1e-9, k * k * (2 * (square - square**2) + 4 * (n - 1) * (cube - square**2))))
    p1 = below((stat - mean) / spread)
    # runs of one class (digit, lower, upper): natural tokens keep a class; many runs are random
    kinds = [classes(c) for c in body if c.isalnum()]
    runs, steps = sum(a != b for a, b in zip(kinds, kinds[1:])), max(1, len(kinds) - 1)
    p2 = below(-(runs - 0.5 - CHANGES * steps) / math.sqrt(CHANGES * (1 - CHANGES) * steps))
    # serial correlation of places in the alphabet: ordered strings (abcd, 1234, aaaa) have a high one
    at = {c: i for i, c in enumerate(alphabet)}
    v = [at[c] for c in body]
    m = sum(v) / n
    var = sum((x - m) ** 2 for x in v)
    serial = sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / var if var else 1.0
    p3 = min(1.0, below((serial - 0.35) * math.sqrt(n)) * 2)
    if max(p1, p2) > 0.99 or p3 == 1.0:
        return 0
    fisher = -2 * sum(math.log(max(p, 1e-30)) for p in (p1, p2, p3))
    half = fisher / 2  # chi-squared with six degrees of freedom
    return int(-math.log10(max(1e-60, min(1.0, math.exp(-half) * (1 + half + half * half / 2)))) * GRID)


def natural_tokens(text: str) -> Iterator[str]:
    """Words of a text put together, around its first number in each thousand characters; strings that are candidates themselves are left out."""
    for k, lo in enumerate(range(0, len(text), STEP)):
        piece = RUN.sub(" ", text[lo : lo + STEP])
        digit = DIGIT.search(piece)
        at, n = digit.start() if digit else 0, NATURAL[(k + len(text)) % len(NATURAL)]
        while at > 0 and piece[at - 1] > " ":
            at -= 1
        if len(token := MARKS.sub("", piece[at : at + 4 * n])[:n]) == n:
            yield token


def natural_statistic(token: str, usage: dict[str, float]) -> tuple[int, int]:
    """Class of length, and statistic in the narrowest alphabet."""
    chars = set(token)
    return _length_class(len(token)), statistic(token, next(x for _, x in ALPHABETS if chars <= set(x)), usage)


def tail(nulls: dict[int, int]):
    """The share of natural tokens with a statistic as high, from how many have which."""
    total, above, u = sum(nulls.values()), 0, 0
    if not total:
        return lambda s: 10 ** (-s / GRID)
    for value in sorted(nulls, reverse=True):
        above, u = above + nulls[value], value
        if above >= 0.05 * total:
            break
    excess = sum((v - u) * n for v, n in nulls.items() if v >= u) / above
    upto, at = {}, 0
    for value in sorted(nulls, reverse=True):
        at += nulls[value]
        upto[value] = at

    def share(s: int) -> float:
        if s > u:
            return above / total * math.exp(-(s - u) / max(excess, 1.0))
        return upto[min(v for v in upto if v >= s)] / total

    return share


def _usage(docs: DataFrame, text: str) -> dict[str, float]:
    """Share of each character in all texts, letters and digits; at most a few dozen rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(DIGITS + UPPER + LOWER + "+/-_", 0)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                for c in total:
                    total[c] += raw.count(c.encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    rows = docs.select(text).mapInArrow(count, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    whole = sum(r["n"] for r in rows) or 1
    return {r["c"]: r["n"] / whole for r in rows}


def _length_class(n: int) -> int:
    return next(k for k, most in enumerate(LENGTHS) if n <= most)


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, and found, the spans as an array.

    Random strings that overlap a base span are not added.  A null or empty
    text has no spans.  Rows alike have the same result, each counts in the
    control of false discoveries.  An empty table gives an empty result.  Other
    columns are dropped.
    """
    spark = docs.sparkSession
    importable(spark)
    usage = spark.sparkContext.broadcast(_usage(docs, text))
    kind = docs.schema[id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("l", pa.int32()), ("p", pa.int32())])
        for batch in batches:
            rows, nulls = [], []
            for t in batch.column(1).to_pylist():
                t, out = t or "", []
                if long_words(t) or any(k in t.lower() for k in KEYS):
                    base = base_spans(t)
                    out = [{"s": a, "k": k, "e": e, "l": 0, "p": 0} for a, k, e in base]
                    for m in RUN.finditer(t):
                        if (found := encoding(m[0])) and not any(a < m.end() and m.start() < e for a, _, e in base):
                            out.append({"s": m.start(), "k": 3, "e": m.end(), "l": _length_class(len(m[0])), "p": statistic(m[0], found[1], usage.value)})
                rows.append(out)
                nulls.append([{"l": l, "p": p} for l, p in (natural_statistic(x, usage.value) for x in natural_tokens(t))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span)), pa.array(nulls, pa.list_(pa.struct([("l", pa.int32()), ("p", pa.int32())])))], names=[id, "c", "natural"])

    scratch = Scratch(spark, "secrets")
    table = scratch.write(docs.select(id, text).mapInArrow(scan, f"`{id}` {kind}, c array<struct<s:int,k:int,e:int,l:int,p:int>>, natural array<struct<l:int,p:int>>"), "candidates")
    limits = thresholds(table, rate)
    wanted = F.filter("c", lambda x: (x["k"] < 3) | (x["p"] >= F.get(F.array(*map(F.lit, limits)), x["l"])))
    out = table.select(id, F.sort_array(F.transform(wanted, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))).alias("found"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return out.select(id, *map(number, range(3)), F.sha2(listed(F.filter("found", lambda x: x["k"] < 3)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")


def thresholds(table: DataFrame, rate: float = RATE) -> list[int]:
    """Least statistic that is a discovery, for each class of length.

    Only histograms, classes x grid at most, reach the driver.
    """
    count = lambda c, keep: table.select(F.explode(c).alias("x")).filter(keep).groupBy("x.l", "x.p").agg(F.count("*").alias("n")).collect()
    own, natural = count("c", "x.k = 3"), count("natural", "true")
    return [discoveries({r["p"]: r["n"] for r in own if r["l"] == k}, tail({r["p"]: r["n"] for r in natural if r["l"] == k}), rate) for k in range(len(LENGTHS))]


def discoveries(own: dict[int, int], share, rate: float) -> int:
    """Benjamini-Hochberg: the least statistic s with share(s) * candidates <= rate * (candidates from s on)."""
    total, upto, limit = sum(own.values()), 0, 1 << 30
    for s in sorted(own, reverse=True):
        upto += own[s]
        if share(s) * total <= rate * upto:
            limit = s
    return limit
