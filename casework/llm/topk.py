"""Exact top-k inner products with KD-trees per shard (operator 4).

Vectors become whole numbers, floor(64 x), and are dealt into shards by place
(``vector_shards``).  A shard is a KD-tree: median splits along the widest side, tight
boxes at every node.  The largest inner product a query can have within a box
is the sum over components of max(q lo, q hi).  A batch of queries descends
with all boxes whose bound still reaches its kth score, visits the remaining
leaves best bound first and raises the kth score as it goes.

First every query is searched in its own shard; its kth score there is a lower
bound that goes with it to the other shards whose whole box reaches it.  A
shard's rows are moved once and its tree is built once, whatever the number of
queries.  Nothing is sampled and no box is skipped whose bound equals the kth
score, so ties are exact.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part; every other row counts, also where ids
repeat: a query's candidates are the rows of other ids, and query rows of one
id share one ranking; vectors of another length than the query's are not
comparable; an empty table, or a query without other vectors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.vector_shards import (BATCH, SHARD_ROWS, arrow, at_home, dealt, matrix, products, routed, streamed,
                                        summaries, whole_rows)
from casework.session import materialize

LEAF = 128
NONE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Nodes in breadth-first order; ``left`` is 0 at a leaf, which has rows start to end."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        low, high, left, start, end, todo = [], [], [], [], [], [(0, len(ids))]
        while len(low) < len(todo):
            i, j = todo[len(low)]
            own = points[order[i:j]]
            a, b = own.min(axis=0), own.max(axis=0)
            axis = int(np.argmax(b - a))
            low.append(a)
            high.append(b)
            start.append(i)
            end.append(j)
            if j - i > leaf and b[axis] > a[axis]:
                mid = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(own[:, axis], mid)]
                left.append(len(todo))
                todo += [(i, i + mid), (i + mid, j)]
            else:
                left.append(0)
        return cls(ids[order], points[order], *(np.array(x) for x in (low, high, left, start, end)))

    def search(self, qids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of candidates that hold each query's k best here."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        kth, everyone = kth.copy(), np.arange(len(queries))
        nodes, who, leaves = np.zeros(len(queries), np.int64), everyone, []
        while len(nodes):  # all open (node, query) pairs of a level at once
            bound = np.empty(len(nodes), np.int64)
            for node in np.unique(nodes):
                at = nodes == node
                bound[at] = (products(plus[who[at]], self.high[node][None])
                             + products(minus[who[at]], self.low[node][None]))[:, 0]
            open_ = bound >= kth[who]
            nodes, who, bound = nodes[open_], who[open_], bound[open_]
            is_leaf = self.left[nodes] == 0
            leaves.append((nodes[is_leaf], who[is_leaf], bound[is_leaf]))
            inner, who = self.left[nodes[~is_leaf]], who[~is_leaf]
            nodes, who = np.concatenate([inner, inner + 1]), np.concatenate([who, who])
        nodes, who, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
        order = np.lexsort((-bound, who))
        nodes, who, bound = nodes[order], who[order], bound[order]
        first = np.searchsorted(who, everyone)
        last = np.searchsorted(who, everyone, "right")
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        turn = 0
        while True:  # each query's next best leaf
            at = first + turn
            live = at < last
            live[live] = bound[at[live]] >= kth[live]
            if not live.any():
                return top
            mine, leaf = everyone[live], nodes[at[live]]
            found = [top]
            for node in np.unique(leaf):
                q = mine[leaf == node]
                i, j = self.start[node], self.end[node]
                score = products(queries[q], self.points[i:j])
                good = (score >= kth[q][:, None]) & (self.ids[None, i:j] != qids[q][:, None])
                x, y = np.nonzero(good)
                found.append((q[x], self.ids[i + y], score[x, y]))
            if sum(len(f[0]) for f in found[1:]):
                top, kth = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), kth, k)
            turn += 1


def _best(who, ids, score, kth, k):
    """The k best of each query, and the raised kth scores."""
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    last = rank == k - 1
    kth = kth.copy()
    kth[who[last]] = np.maximum(kth[who[last]], score[last])
    keep = rank < k
    return (who[keep], ids[keep], score[keep]), kth


_FOUND = {"row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
FOUND = "row long, query_id long, vec_id long, score long"


def _tree(rows: pa.Table) -> Tree:
    return Tree.build(rows.column("id").to_numpy(), matrix(rows.column("vec").to_pylist()))


def _search(tree: Tree, queries: pa.Table, kth: np.ndarray, k: int) -> pa.RecordBatch:
    ids = queries.column("id").to_numpy()
    who, found, score = tree.search(ids, matrix(queries.column("vec").to_pylist()), kth, k)
    return arrow(_FOUND, {"row": queries.column("row").to_numpy()[who], "query_id": ids[who], "vec_id": found, "score": score})


def top_k(df: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of every vector whose id is divisible by ``query_every``."""
    shards = dealt(whole_rows(df, 64, id_col, vec_col), shard_rows)

    def home(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tree = _tree(rows)
        mine = rows.filter(pa.array(rows.column("id").to_numpy() % query_every == 0))
        for at in range(0, mine.num_rows, query_rows):
            part = mine.slice(at, query_rows)
            yield _search(tree, part, np.full(part.num_rows, NONE), k)

    def may(queries: pa.Table, x: np.ndarray, held: pa.Table, loads: np.ndarray) -> np.ndarray:
        low, high = np.split(loads.astype(np.int64), 2, axis=1)
        bound = products(np.maximum(x, 0), high) + products(np.minimum(x, 0), low)
        elsewhere = queries.column("home").to_numpy()[:, None] != held.column("shard").to_numpy()[None]
        return (bound >= queries.column("kth").to_numpy()[:, None]) & elsewhere

    def away(tree: Tree, asked: pa.Table) -> pa.RecordBatch:
        found = _search(tree, asked, asked.column("kth").to_numpy(), k)
        # a score equal to the kth needs a smaller id
        rows = asked.column("row").to_numpy()
        order = np.argsort(rows)
        at = order[np.searchsorted(rows, found.column("row").to_numpy(), sorter=order)]
        score, ids = found.column("score").to_numpy(), found.column("vec_id").to_numpy()
        return found.filter(pa.array((score > asked.column("kth").to_numpy()[at]) | (ids < asked.column("last").to_numpy()[at])))

    first = materialize(at_home(shards, home, FOUND))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    kth = (first.withColumn("i", F.row_number().over(order)).where(F.col("i") == k)
           .select("row", F.col("score").alias("kth"), F.col("vec_id").alias("last")))
    queries = materialize(
        shards.where(F.col("id") % query_every == 0).join(kth, "row", "left")
        .select("row", "id", "label", "dim", "vec", F.col("shard").alias("home"), F.coalesce("kth", F.lit(int(NONE))).alias("kth"),
                F.coalesce("last", F.lit(-int(NONE) - 1)).alias("last")))
    boxes = materialize(summaries(shards, lambda x: np.concatenate([x.min(axis=0), x.max(axis=0)]), _join_boxes))
    second = streamed(shards, routed(queries, boxes, may), _tree, away, FOUND, query_rows)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(second).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _join_boxes(loads: np.ndarray) -> np.ndarray:
    low, high = np.split(loads, 2, axis=1)
    return np.concatenate([low.min(axis=0), high.max(axis=0)])
