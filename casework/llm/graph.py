"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.session import materialize


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # point every node at its root
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


#: a node with more than this share of all rows has its minimum laid out in parts
_HOT_SHARE = 1024
_PARTS = 64


def _with_low(rows: DataFrame, low: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (u, v) with the minimum m of their u, from ``low`` (u, m, n: rows
    of u).  The rows of a node with over 1/1024 of ``n_rows`` (so fewer than 1024
    nodes, which are broadcast) meet its minimum in ``_PARTS`` places."""
    hot = F.col("n") > max(1000, n_rows // _HOT_SHARE)
    heavy = F.broadcast(low.where(hot).select("u", F.lit(True).alias("_hot")))
    dealt = (rows.join(heavy, "u", "left")
             .withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64("v"), F.lit(_PARTS)).cast("int")).otherwise(0)).drop("_hot"))
    parts = low.select("u", "m", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("_part"))
    return dealt.join(parts, ["u", "_part"]).drop("_part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root: the smallest node of
    its component.  ``edges``: columns a, b.

    Rounds of large-star and small-star: every node hangs its larger, then its
    smaller neighbours on the smallest node it sees.  Only minima are
    aggregated, so a node with very many edges is never gathered, and its edges
    are dealt into parts to meet the minimum (``_with_low``); each round
    is written to the checkpoint folder.
    """
    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = (_with_low(both.where("v > u"), low, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (_with_low(large, low, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        e = materialize(small)
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
