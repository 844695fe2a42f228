"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more component, so that the largest inner product becomes the
least Euclidean distance.  Each of ``TABLES`` tables projects them on Gaussian
directions (made orthogonal) and cuts each projection into cells; a bucket is a
tuple of cells.  A neighbour's projection is the query's, shrunk, with Gaussian
noise, so each cell has an estimated chance of holding it.  A query visits the
buckets of a table in the order of these chances, its own first, then
perturbed ones, up to a number of probes.  Shrinkage, noise, the number of
directions and that of probes are fitted on a bounded sample of queries whose
true neighbours are found by brute force over all rows.  Every row is indexed.

A bucket's number begins with the cells of its first directions, and buckets
whose numbers begin alike are one group: the number of groups follows the number of
rows, and a query goes only to those of its buckets.  Both sides of a group are
split into blocks of bounded size, so neither a crowded bucket nor a popular
group fills a task.  What the tables find is merged, a vector once, and ranked
by the exact product.  Rows with one and the same vector are one index entry
with its smallest ids, which is all that a list of k can show of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, importable, join_dimension
from .tokens import ragged

TABLES = 16
#: Cells of a direction, and their width in standard deviations: two hold nearly all rows.
CELLS = 4
WIDTH = 3.0
#: Most directions of a table, at first three more than would give each row a bucket, and most buckets that a query visits in it.
DIRECTIONS = 30
PROBES = 2048
#: Queries of the fitted sample, and the share of their true neighbours that the probes must reach.
SAMPLE = 256
AIM = 0.92
#: Entries of a group or block, queries of a block, and queries that a task looks up at once.
BLOCK = 100_000
ASKED = 16_000
AT_ONCE = 128
#: Rows that meet the fitted sample at once; bounds a task's memory whatever the size of its batches.
AT_ONCE_TRUTH = 2048
SEED = 20


class Model:
    """Directions, cell borders, and what a neighbour's projections look like."""

    def __init__(self, dims: int, top: float, directions: int):
        self.top, self.per = top, directions
        rng = np.random.default_rng(SEED)
        n = TABLES * directions
        draws = rng.normal(size=(n, dims + 1))
        self.directions = np.concatenate([np.linalg.qr(draws[k : k + dims + 1].T)[0].T for k in range(0, n, dims + 1)])
        self.shift = rng.uniform(-0.25, 0.25, n)
        self.mean, self.spread, self.shrink, self.noise = np.zeros(n), np.ones(n), 1.0, np.ones(n)
        self.probed = 1

    def narrowed(self, directions: int) -> Model:
        """The same with fewer directions in each table."""
        out = object.__new__(Model)
        keep = (np.arange(TABLES)[:, None] * self.per + np.arange(directions)).ravel()
        out.top, out.per, out.shrink, out.probed = self.top, directions, self.shrink, self.probed
        for name in ("directions", "shift", "mean", "spread", "noise"):
            setattr(out, name, getattr(self, name)[keep])
        return out

    def extend(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1)
        if query:
            return np.concatenate([x * (self.top / norm)[:, None], np.zeros((len(x), 1))], 1)
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - norm**2, 0))[:, None]], 1)

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return self.extend(x, query) @ self.directions.T

    def borders(self) -> np.ndarray:
        """Inner cell borders of each direction."""
        steps = np.arange(CELLS - 1) - (CELLS - 2) / 2
        return self.mean[:, None] + self.spread[:, None] * (WIDTH * steps[None, :] + self.shift[:, None])

    def buckets(self, projected: np.ndarray) -> np.ndarray:
        """Bucket numbers, one for each row and table; the first direction decides most."""
        cells = (projected[:, :, None] > self.borders()[None]).sum(2)
        return cells.reshape(-1, TABLES, self.per) @ CELLS ** np.arange(self.per - 1, -1, -1)

    def costs(self, projected: np.ndarray, table: int) -> np.ndarray:
        """By query, direction of the table and cell: how much less likely than the best cell, in logarithms."""
        own = slice(table * self.per, (table + 1) * self.per)
        z = (self.borders()[None, own] - (self.shrink * projected[:, own])[:, :, None]) / self.noise[None, own, None]
        upto = np.concatenate([np.zeros((*z.shape[:2], 1)), 0.5 * (1 + _erf(z / sqrt(2))), np.ones((*z.shape[:2], 1))], 2)
        logs = np.log(np.maximum(np.diff(upto, axis=2), 1e-12))
        return logs.max(2, keepdims=True) - logs

    def probes(self, projected: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` likeliest buckets of a table for each query, likeliest first.

        Direction by direction the cheapest sums are kept: no prefix beyond the
        first ``most`` can be part of one of the ``most`` cheapest buckets.
        """
        costs = self.costs(projected, table)
        sums, numbers = np.zeros((len(projected), 1)), np.zeros((len(projected), 1), np.int64)
        for d in range(self.per):
            sums = (sums[:, :, None] + costs[:, d, None, :]).reshape(len(sums), -1)
            numbers = (numbers[:, :, None] * CELLS + np.arange(CELLS)).reshape(len(sums), -1)
            if sums.shape[1] > most:
                cheapest = np.argpartition(sums, most - 1, axis=1)[:, :most]
                sums, numbers = np.take_along_axis(sums, cheapest, 1), np.take_along_axis(numbers, cheapest, 1)
        return np.take_along_axis(numbers, np.argsort(sums, axis=1, kind="stable"), 1)

    def group(self, buckets: np.ndarray, depth: int) -> np.ndarray:
        """What a bucket's number begins with: the cells of its first ``depth`` directions."""
        return buckets // CELLS ** (self.per - depth)


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _matrix(column: pa.Array, single: bool) -> np.ndarray:
    """Vectors from a column of their bytes."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f4" if single else "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(single: bool):
    """Arrays of numbers, in the last column, to their bytes: what moves is an eighth of Spark's own arrays or half of it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8")
            rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in rows], pa.binary())], names=[*batch.schema.names[:-1], "v"])

    return pack


def valid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows that take part, as (id, v): ids not null, components finite and not all zero."""
    v = F.col("v")
    out = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL")
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return out.filter(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then id."""
    if len(scores) > k:
        limit = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= limit)
    else:
        some = np.arange(len(scores))
    if ids.dtype == object:
        return np.array(sorted(some.tolist(), key=lambda i: (-scores[i], ids[i])), np.int64)[:k]
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _kept(score: np.ndarray, held: np.ndarray, more: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query and their vectors, after those held met the rows x with the products ``more``; only the k are copied."""
    both = np.concatenate([score, more], 1)
    take = np.argsort(-both, axis=1, kind="stable")[:, :k]
    old = take < score.shape[1]
    out = np.empty((*take.shape, x.shape[1]))
    query, place = np.nonzero(old)
    out[query, place] = held[query, take[old]]
    out[~old] = x[take[~old] - score.shape[1]]
    return np.take_along_axis(both, take, 1), out


def fit(entries: DataFrame, queries: DataFrame, k: int, n: int, dims: int, single: bool) -> Model:
    """The model, from one pass for norms, one for the spread, and one that finds the sample's true neighbours."""
    spark = entries.sparkSession

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.linalg.norm(_matrix(b.column(0), single).astype(float), axis=1).max(initial=0) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([max(top, default=0.0)])], names=["top"])

    top = entries.select("v").mapInArrow(norms, "top double").agg(F.max("top")).first()[0]
    model = Model(dims, top * (1 + 1e-9), max(1, min(DIRECTIONS, round(log2(n + 1)) + 3)))
    shared = spark.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.project(_matrix(batch.column(0), single).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.shape[1])), pa.array(np.full(p.shape[1], float(len(p)))), pa.array(p.sum(0)), pa.array((p * p).sum(0))], names=["j", "n", "s", "q"])

    sums = entries.select("v").mapInArrow(moments, "j bigint, n double, s double, q double").groupBy("j").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("j").collect()
    count, s, q = (np.array([r[c] for r in sums]) for c in (1, 2, 3))
    model.mean = s / count
    model.spread = np.sqrt(np.maximum(q / count - model.mean**2, 1e-12))
    chosen = [r["v"] for r in queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    if not chosen:
        return model
    sample = _matrix(pa.array(chosen), single).astype(float)
    asked = spark.sparkContext.broadcast(sample)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a task for each query of the sample."""
        score, held = np.zeros((len(sample), 0)), np.zeros((len(sample), 0, dims))
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE_TRUTH):
                x = _matrix(batch.column(0).slice(lo, AT_ONCE_TRUTH), single).astype(float)
                score, held = _kept(score, held, asked.value @ x.T, x, k + 1)
        some = held.reshape(-1, dims)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sample)), score.shape[1])), pa.array(score.ravel()), pa.array([r.tobytes() for r in some], pa.binary())], names=["q", "score", "v"])

    found = entries.select("v").mapInArrow(truth, "q bigint, score double, v binary")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    near = found.withColumn("rank", rank).filter((F.col("rank") > 1) & (F.col("rank") <= k + 1)).collect()  # the first is the query itself; SAMPLE x k rows
    if not near:
        return model
    whose, theirs = np.array([r["q"] for r in near]), model.project(np.stack([np.frombuffer(r["v"]) for r in near]))
    own = model.project(sample, query=True)
    model.shrink = float((own[whose] * theirs).sum() / max((own[whose] ** 2).sum(), 1e-12))
    model.noise = np.maximum((theirs - model.shrink * own[whose]).std(0), 1e-3 * model.spread)
    for directions in range(model.per, 0, -1):
        tried = model.narrowed(directions)
        keep = (np.arange(TABLES)[:, None] * model.per + np.arange(directions)).ravel()
        where, first = tried.buckets(theirs[:, keep]), np.full(len(whose), np.inf)
        for t in range(TABLES):
            order = tried.probes(own[:, keep], t, PROBES)
            for lo in range(0, len(whose), 1000):
                hit = order[whose[lo : lo + 1000]] == where[lo : lo + 1000, t, None]
                first[lo : lo + 1000] = np.minimum(first[lo : lo + 1000], np.where(hit.any(1), hit.argmax(1) + 1.0, np.inf))
        reach = np.quantile(first, AIM, method="higher")
        if reach <= PROBES:
            tried.probed = int(reach)
            return tried
    tried.probed = CELLS
    return tried


def search(vectors: DataFrame, is_query, k: int = 20, id: str = "vec_id", vector: str = "embedding", counted: bool = False) -> DataFrame:
    """For each query row its k nearest other rows found: query_id, rank, vec_id, score.

    Vectors null, of another length than most, all zero, or with null or
    non-finite components, and rows without an id, take no part.  Rows alike
    are one; a vector with many ids is one candidate for each.  Fewer than k
    candidates are all returned.  An empty table gives an empty result.  Other
    columns are dropped.  ``counted`` gives (id, scored) instead: how many
    distinct vectors each query was compared with.
    """
    spark = vectors.sparkSession
    importable(spark)
    scratch = Scratch(spark, "neighbours")
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = vectors.schema[id].dataType.simpleString()
    rows = valid(vectors, id, vector)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (usual["n"] if usual else 0))
    rows = scratch.write(rows.mapInArrow(_packed(single), f"id {kind}, v binary").withColumn("h", F.xxhash64("v")), "rows")
    by_vector = Window.partitionBy("h", "v").orderBy("id")
    firsts = rows.withColumn("rank", F.dense_rank().over(by_vector)).filter(F.col("rank") <= k + 1)
    entries = scratch.write(firsts.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("id", F.get("ids", F.lit(0))), "entries")
    asked = scratch.write(rows.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "h", "v").distinct(), "asked")
    queries = scratch.write(asked.select("h", "v").distinct().join(entries.select("h", "v", "id"), ["h", "v"]).select("id", "v"), "queries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    model = fit(entries, queries, k, n, usual["n"], single)
    depth = min(model.per, max(0, round(log2(n / BLOCK)) if n > BLOCK else 0))
    shared = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.buckets(shared.value.project(_matrix(batch.column(1), single).astype(float)))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, np.int32)), pa.array(shared.value.group(codes[:, t], depth)), pa.array(codes[:, t]), *batch.columns], names=["t", "g", "bucket", "id", "v", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                projected = model.project(_matrix(part.column(1), single).astype(float), query=True)
                for t in range(TABLES):
                    if depth:
                        groups = [np.unique(g) for g in model.group(model.probes(projected, t, model.probed), depth)]
                    else:
                        groups = [np.zeros(1, np.int64)] * len(projected)
                    take = pa.array(np.repeat(np.arange(len(groups)), list(map(len, groups))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t, np.int32)), pa.array(np.concatenate(groups)), part.column(0).take(take), part.column(1).take(take)], names=["t", "g", "id", "v"])

    left = scratch.write(entries.select("id", "v", "ids").mapInArrow(index, f"t int, g bigint, bucket bigint, id {kind}, v binary, ids array<{kind}>"), "index")
    right = scratch.write(queries.mapInArrow(probe, f"t int, g bigint, id {kind}, v binary"), "probes")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: the entries of a block (side 0), then its queries (side 1; 2: queries that want all)."""
        key, parts, block = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in range(5)], 1)
            borders = np.flatnonzero(np.any(at[1:] != at[:-1], axis=1)) + 1
            for lo, hi in zip([0, *borders.tolist()], [*borders.tolist(), len(at)]):
                if hi == lo:
                    continue
                now, side, run = tuple(at[lo, :4].tolist()), int(at[lo, 4]), batch.slice(lo, hi - lo)
                if now != key:
                    key, parts, block = now, [], None
                if side == 0:
                    parts.append(run)
                    continue
                if block is None:
                    block = _block(parts, single)
                    parts = []
                for a in range(0, run.num_rows, AT_ONCE):
                    yield _answer(shared.value, block, run.slice(a, AT_ONCE), key[0], side == 2, k, single, counted)

    def look(index: DataFrame, probes: DataFrame, side: int, name: str) -> DataFrame:
        """The best of what the probes visit.  Each group has its entries in a, its queries in b parts; every part of one side meets every one of the other."""
        size = index.groupBy("t", "g").agg(F.ceil(F.count("*") / BLOCK).alias("a"))
        size = size.join(probes.groupBy("t", "g").agg(F.ceil(F.count("*") / ASKED).alias("b")), ["t", "g"])
        size = scratch.write(size.select(F.struct("t", "g").alias("at"), "a", "b"), f"{name}-sizes")
        groups, zero = size.count(), F.lit(0).cast("bigint")
        index = join_dimension(index.withColumn("at", F.struct("t", "g")), size, "at", groups, "inner").drop("at")
        probes = join_dimension(probes.withColumn("at", F.struct("t", "g")), size, "at", groups, "inner").drop("at")
        index = index.withColumn("x", F.pmod(F.xxhash64("id"), F.col("a"))).withColumn("y", F.explode(F.sequence(zero, F.col("b") - 1)))
        probes = probes.withColumn("y", F.pmod(F.xxhash64("id"), F.col("b"))).withColumn("x", F.explode(F.sequence(zero, F.col("a") - 1)))
        both = index.select("t", "g", "x", "y", F.lit(0).alias("side"), "bucket", "id", "v", "ids").unionByName(
            probes.select("t", "g", "x", "y", F.lit(side).alias("side"), F.lit(0).cast("bigint").alias("bucket"), "id", "v", F.lit(None).cast(f"array<{kind}>").alias("ids")))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 1)
        spread = both.repartition(tasks, "t", "g", "x", "y").sortWithinPartitions("t", "g", "x", "y", "side")
        return scratch.write(spread.mapInArrow(visit, f"id {kind}, ids array<{kind}>, score double"), name)

    near = look(left, right, 1, "near")
    if counted:
        return near.select("id", F.get("ids", F.lit(0)).alias("vec_id")).distinct().groupBy("id").agg(F.count("*").alias("scored"))
    # a query whose buckets held fewer than it wants visits all buckets of one table, which hold every entry
    wanted = min(k + 1, entries.agg(F.sum(F.size("ids"))).first()[0])
    flat = near.select("id", F.explode("ids").alias("vec_id"), "score").groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    full = flat.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted).select("id")
    short = scratch.write(queries.join(full, "id", "left_anti"), "short")
    if not short.isEmpty():
        groups = left.filter("t = 0").select("t", "g").distinct()
        rest = look(left.filter("t = 0"), short.join(groups, F.lit(True)) if groups.count() == 1 else _everywhere(short, groups), 2, "rest")
        flat = flat.join(full, "id", "left_semi").unionByName(rest.select("id", F.explode("ids").alias("vec_id"), "score"))
    lists = flat.groupBy("id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))).alias("near"))  # k + 1 a table and block
    named = asked.join(entries.select("h", "v", "id"), ["h", "v"]).select("query_id", "id").join(lists, "id")
    own = F.slice(F.filter(F.sort_array("near"), lambda x: x["v"] != F.col("query_id")), 1, k)
    placed = named.select("query_id", F.posexplode(own).alias("at", "x"))
    out = scratch.write(placed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score")), "found")
    scratch.drop("rows", "entries", "asked", "queries", "index", "probes", "near", "near-sizes", "short", "rest", "rest-sizes")
    return out


def _everywhere(short: DataFrame, groups: DataFrame) -> DataFrame:
    """Queries that found too few, once for each group: stated queries against all rows."""
    listed = groups.agg(F.collect_list(F.struct("t", "g")).alias("all")).first()["all"]  # one table's groups: entries / BLOCK or so
    return short.withColumn("at", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(g).cast("bigint").alias("g")) for t, g in listed)))).select("at.t", "at.g", "id", "v")


def _block(parts: list[pa.RecordBatch], single: bool) -> tuple:
    """Entries by bucket: vectors, ids, lists of ids, distinct buckets and where they start."""
    table = pa.Table.from_batches(parts).combine_chunks() if parts else None
    if table is None:
        return np.zeros((0, 1)), np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(1, np.int64)
    bucket = table.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    x = _matrix(table.column("v").combine_chunks(), single)[order]
    first, lists = table.column("id").take(pa.array(order)), table.column("ids").take(pa.array(order))
    ids = first.to_numpy() if pa.types.is_integer(first.type) else np.array([*first.to_pylist(), None], object)[:-1]
    buckets, starts = np.unique(bucket[order], return_index=True)
    return x, ids, lists.combine_chunks(), buckets, np.append(starts, len(order))


def _answer(model: Model, block: tuple, asked: pa.RecordBatch, table: int, every: bool, k: int, single: bool, counted: bool) -> pa.RecordBatch:
    """For each query the best of the rows in the buckets that it visits, with all others that tie with the last."""
    x, ids, lists, buckets, starts = block
    q = _matrix(asked.column("v"), single).astype(float)
    probes = None if every else model.probes(model.project(q, query=True), table, model.probed)
    who, rows, scores = [], [], []
    for i in range(len(q)):
        if every or not len(buckets):
            some = np.arange(len(x))
        else:
            at = np.minimum(np.searchsorted(buckets, probes[i]), len(buckets) - 1)
            at = at[buckets[at] == probes[i]]
            some = ragged(np.arange(len(x)), starts[at], starts[at + 1] - starts[at])
        best = some if counted else some[_best(x[some] @ q[i], ids[some], k + 9)]
        exact = (x[best].astype(float) * q[i]).sum(1)
        keep = np.arange(len(best)) if counted else _best(exact, ids[best], k + 1)
        who.append(np.full(len(keep), i)), rows.append(best[keep]), scores.append(exact[keep])
    who, rows, scores = (np.concatenate(v) for v in (who, rows, scores))
    lists = lists.take(pa.array(rows)) if lists is not None else pa.nulls(0, asked.schema.field("ids").type)
    return pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(who)), lists, pa.array(scores)], names=["id", "ids", "score"])
