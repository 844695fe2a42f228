"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.storage import Scratch


def _pairs(df: DataFrame, u, v) -> DataFrame:
    return df.select(u.alias("u"), v.alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return _pairs(both.filter("v > u").join(least, F.col("u") == F.col("c")), F.col("v"), F.col("m"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    moved = down.join(least, F.col("u") == F.col("c")).select(F.col("v"), F.col("m"))
    return _pairs(moved.unionByName(least.select(F.col("c").alias("v"), "m")), F.col("v"), F.col("m"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has two columns u and v of one type, in any direction; repeated edges and
    loops do no harm.  Large-star and small-star steps alternate until nothing
    changes; the edges never grow in number, minima are combined before the
    shuffle, and the joins are plain ones that adaptive execution splits where
    a hub is hot.  Each round is a written table, so a lost executor costs one
    round at most.
    """
    current = scratch.write(_pairs(edges, F.greatest("u", "v"), F.least("u", "v")), "edges-0")
    seen, k = _signature(current), 0
    while seen[0]:
        k += 1
        nxt = scratch.write(_small_star(_large_star(current)), f"edges-{k}")
        now = _signature(nxt)
        scratch.drop(f"edges-{k - 1}")
        current = nxt
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge, roots too."""
    found = connected_components(edges, scratch)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def merged(known: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(all labels, those that are new or changed) after edges (u, v) came to stored labels (node, root, with a row for each root).

    The ends of the new edges stand for their roots, so the components are
    found on the few roots that the edges touch; only clusters whose root moves
    are written anew.
    """
    new = scratch.write(edges.select("u", "v").filter("u <> v").distinct(), "new-edges")
    ends = new.select(F.col("u").alias("node")).unionByName(new.select(F.col("v").alias("node"))).distinct().join(known, "node", "left")
    ends = scratch.write(ends.select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("fresh")), "ends")
    at = lambda c: ends.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joined = new.join(at("u"), "u").join(at("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).filter("u <> v")
    moved = scratch.write(connected_components(joined, scratch).select(F.col("node").alias("root"), F.col("root").alias("to")), "moved")
    stay = known.join(moved.select("root"), "root", "left_anti").select("node", "root")
    changed = known.join(moved, "root").select("node", F.col("to").alias("root"))
    fresh = ends.filter("fresh").select("node", "root").join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    changed = scratch.write(changed.unionByName(fresh), "changed")
    return stay.unionByName(changed), changed


def recomputed(known: DataFrame, edges: DataFrame, touched: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(all labels, those of touched clusters) when edges went away: ``edges`` are those that are left, ``touched`` the nodes that lost one.

    Only edges inside of clusters with a touched node are looked at; nodes left
    without an edge have no label any more.
    """
    nodes = touched.select(F.col(touched.columns[0]).alias("node"))
    roots = scratch.write(known.join(nodes, "node", "left_semi").select("root").distinct(), "touched-roots")
    inside = known.join(roots, "root", "left_semi").select(F.col("node").alias("u"))
    again = scratch.write(labels(edges.select("u", "v").join(inside, "u", "left_semi"), scratch), "again")
    return known.join(roots, "root", "left_anti").select("node", "root").unionByName(again), again
