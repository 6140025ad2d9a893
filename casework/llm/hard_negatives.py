"""Hard negatives by segment summaries (operator 13).

An anchor's positives are the best rows of its own label; for each of them the
hard negatives are the best rows of other labels whose score lies within a
share of the positive's.  Scores are inner products of whole numbers.

A vector is cut into a few segments; each keeps its mean and its deviation (the
length of what is left when the mean is taken out).  Within a segment of m
components the product of two vectors is m times the product of the means, plus
or minus at most the product of the deviations; the sum over segments bounds
the whole score from both sides.  The bounds are taken with few segments first,
then with more, and only the pairs that may still matter are scored exactly.  A
shard has such a summary too (the range of its means, its largest deviations),
so that an anchor goes only to shards that may hold a row it needs: for
positives those that reach the scores found in its own shard, for negatives
those that reach the positives' intervals and what the most promising ones gave.

Defined results: rows with a null id or label, or a vector that is null, empty
or holds null or non-finite components, take no part.  Every other row counts
by itself, also where ids repeat: an anchor's candidates are all other rows of
its vector's length, ties go to the smaller id, and repeated anchor rows each
give their own result rows.  A positive with a negative score has an empty
interval.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.vector_shards import SHARD_ROWS, arrow, at_home, dealt, matrix, products, routed, streamed, summaries, whole_rows
from casework.session import materialize

LEVELS = (4, 16)
#: shards of highest bound that an anchor sees first, for each group of summaries
FIRST_SHARDS = 2
NONE = np.iinfo(np.int64).min
#: share of the vectors' lengths that covers the rounding of the bounds
_SLACK = 1e-9


def segment_summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and segment: the mean times the root of the segment's length, and the deviation."""
    parts = [p for p in np.array_split(x.astype(np.float64), segments, axis=1) if p.shape[1]]
    means = [p.mean(axis=1, keepdims=True) for p in parts]
    deviation = [np.sqrt(((p - m) ** 2).sum(axis=1)) for p, m in zip(parts, means, strict=True)]
    return (np.concatenate([m * np.sqrt(p.shape[1]) for p, m in zip(parts, means, strict=True)], axis=1),
            np.stack(deviation, axis=1))


class Segments:
    """Rows with their summaries, coarse to fine."""

    def __init__(self, rows: pa.Table):
        self.row, self.id, self.label = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
        self.x = matrix(rows.column("vec").to_pylist())
        self.levels = [segment_summary(self.x, n) for n in LEVELS if n < self.x.shape[1]]
        self.length = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))

    def scored(self, queries: Segments, open_: np.ndarray, low: np.ndarray, high: np.ndarray | None, best: int = 0):
        """(query, row, score) of the open pairs with ``low`` <= score <= ``high``.

        With ``best``, ``low`` rises first to the ``best``-th score among the
        rows whose middle of the bounds is highest."""
        low, cols = low.astype(np.float64), np.flatnonzero(open_.any(axis=0))
        open_ = open_[:, cols]
        slack = _SLACK * queries.length[:, None] * self.length.max(initial=0) + _SLACK
        for (mean, deviation), (own, spread) in zip(queries.levels, self.levels, strict=True):
            if not len(cols):
                break
            middle, radius = mean @ own[cols].T, deviation @ spread[cols].T + slack
            if best and len(cols) >= best:
                likely = np.argpartition(np.where(open_, -middle, np.inf), best - 1, axis=1)[:, :best]
                score = np.einsum("qd,qbd->qb", queries.x.astype(np.float64), self.x[cols[likely]].astype(np.float64))
                score = np.where(np.take_along_axis(open_, likely, axis=1), score, -np.inf)
                low = np.maximum(low, score.min(axis=1) - slack[:, 0])
            open_ = open_ & (middle + radius >= low[:, None])
            if high is not None:
                open_ &= middle - radius <= high[:, None]
            left = np.flatnonzero(open_.any(axis=0))
            cols, open_ = cols[left], open_[:, left]
        score = products(queries.x, self.x[cols])
        good = open_ & (score >= low[:, None])
        if high is not None:
            good &= score <= high[:, None]
        who, at = np.nonzero(good)
        return who, cols[at], score[who, at]


def _first(who: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of each query's ``n`` highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, who))
    sorted_ = who[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < n]


def shard_summary(x: np.ndarray) -> np.ndarray:
    """The range of the means and the largest deviations, at the finest level."""
    mean, deviation = segment_summary(x, max(LEVELS))
    return np.concatenate([mean.min(axis=0), mean.max(axis=0), deviation.max(axis=0)])


def _join_summaries(loads: np.ndarray) -> np.ndarray:
    low, high, deviation = np.split(loads, 3, axis=1)
    return np.concatenate([low.min(axis=0), high.max(axis=0), deviation.max(axis=0)])


def shard_bounds(x: np.ndarray, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each query can have in each shard."""
    mean, deviation = segment_summary(x, max(LEVELS))
    low, high, most = np.split(loads, 3, axis=1)
    up, down = np.maximum(mean, 0), np.minimum(mean, 0)
    radius = deviation @ most.T
    radius += _SLACK * (np.abs(mean) @ np.maximum(np.abs(low), np.abs(high)).T + radius) + _SLACK
    return up @ low.T + down @ high.T - radius, up @ high.T + down @ low.T + radius


_POSITIVE = {"row": pa.int64(), "other": pa.int64(), "score": pa.int64()}
_NEGATIVE = {"row": pa.int64(), "slot": pa.int32(), "other": pa.int64(), "score": pa.int64()}
_ANY = np.iinfo(np.int64).max


def _column(table: pa.Table, name: str, default: int) -> np.ndarray:
    return table.column(name).to_numpy() if name in table.column_names else np.full(table.num_rows, default, np.int64)


def _worst(found: DataFrame, key: list[str], n: int) -> DataFrame:
    """Of each group that has ``n`` rows: the score and the id that another row must beat."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "other")
    return (found.withColumn("_i", F.row_number().over(order)).where(F.col("_i") == n)
            .select(*key, F.col("score").alias("low"), F.col("other").alias("last")))


def positives(shards: DataFrame, bounds: DataFrame, anchor_every: int, n: int) -> DataFrame:
    """(row, slot, positive_id, positive_score): the ``n`` best other rows of each anchor's label."""
    def search(rows: Segments, asked: pa.Table) -> pa.RecordBatch:
        own = Segments(asked)
        low, last = _column(asked, "low", NONE), _column(asked, "last", _ANY)
        same = (own.label[:, None] == rows.label[None]) & (own.row[:, None] != rows.row[None])
        who, at, score = rows.scored(own, same, low, None, best=n)
        better = (score > low[who]) | (rows.id[at] < last[who])
        who, at, score = who[better], at[better], score[better]
        pick = _first(who, score, rows.id[at], n)
        return arrow(_POSITIVE, {"row": own.row[who[pick]], "other": rows.id[at[pick]], "score": score[pick]})

    def home(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, mine = Segments(table), table.filter(pa.array(table.column("id").to_numpy() % anchor_every == 0))
        for at in range(0, mine.num_rows, 256):
            yield search(rows, mine.slice(at, 256))

    def may(asked: pa.Table, x: np.ndarray, held: pa.Table, loads: np.ndarray) -> np.ndarray:
        label = asked.column("label").to_numpy()[:, None]
        reach = shard_bounds(x, loads)[1] >= asked.column("low").to_numpy()[:, None]
        away = asked.column("home").to_numpy()[:, None] != held.column("shard").to_numpy()[None]
        return reach & away & (label >= held.column("low").to_numpy()[None]) & (label <= held.column("high").to_numpy()[None])

    schema = "row long, other long, score long"
    first = materialize(at_home(shards, home, schema))
    asked = materialize(shards.where(F.col("id") % anchor_every == 0).join(_worst(first, ["row"], n), "row", "left").select(
        "row", "id", "label", "dim", "vec", F.col("shard").alias("home"), F.coalesce("low", F.lit(int(NONE))).alias("low"),
        F.coalesce("last", F.lit(int(_ANY))).alias("last")))
    found = first.unionByName(streamed(shards, routed(asked, bounds, may), Segments, search, schema))
    by = Window.partitionBy("row").orderBy(F.col("score").desc(), "other")
    return (found.withColumn("slot", F.row_number().over(by)).where(F.col("slot") <= n)
            .select("row", "slot", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))


def negatives(shards: DataFrame, bounds: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """(row, slot, rank, other, score): the ``n`` best rows of other labels in each of an
    anchor's intervals (row, slot, low, high).

    An anchor is sent to the shards with its highest bounds first; the ``n``-th
    best rows found there are what the rows of the other shards must beat."""
    def ends(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return (np.array([min(v) for v in table.column("lows").to_pylist()], np.int64),
                np.array([max(v) for v in table.column("highs").to_pylist()], np.int64))

    def may(first: bool):
        def pairs(asked: pa.Table, x: np.ndarray, held: pa.Table, loads: np.ndarray) -> np.ndarray:
            low, high = ends(asked)
            least, most = shard_bounds(x, loads)
            label, shard = asked.column("label").to_numpy()[:, None], held.column("shard").to_numpy()
            other = (held.column("low").to_numpy()[None] != label) | (held.column("high").to_numpy()[None] != label)
            fit = other & (most >= low[:, None]) & (least <= high[:, None])
            if first:
                place = np.argsort(np.argsort(np.where(fit, -most, np.inf), axis=1), axis=1)
                return fit & (place < FIRST_SHARDS)
            for i, seen in enumerate(asked.column("seen").to_pylist()):
                fit[i, np.isin(shard, seen)] = False
            return fit
        return pairs

    def search(rows: Segments, asked: pa.Table) -> pa.RecordBatch:
        own = Segments(asked)
        who, at, score = rows.scored(own, own.label[:, None] != rows.label[None], *ends(asked))
        ids = rows.id[at]
        spans = {c: asked.column(c).to_pylist() for c in ("slots", "lows", "lasts", "highs")}
        out = {k: [np.zeros(0, np.int64)] for k in _NEGATIVE}
        for turn in range(max(map(len, spans["slots"]))):  # the turn-th interval of every anchor
            slot, low, last, high = (np.array([v[turn] if turn < len(v) else none for v in spans[c]], np.int64)
                                     for c, none in (("slots", 0), ("lows", _ANY), ("lasts", NONE), ("highs", NONE)))
            better = (score > low[who]) | (score == low[who]) & (ids < last[who])
            mine = np.flatnonzero(better & (score <= high[who]))
            pick = mine[_first(who[mine], score[mine], ids[mine], n)]
            for k, v in (("row", own.row[who[pick]]), ("slot", slot[who[pick]]), ("other", ids[pick]), ("score", score[pick])):
                out[k].append(v)
        return arrow(_NEGATIVE, {k: np.concatenate(v) for k, v in out.items()})

    def asking(spans: DataFrame) -> DataFrame:
        # as many intervals as positives
        one = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "last", "high"))).alias("v"))
        return shards.join(one, "row").select(
            "row", "id", "label", "dim", "vec", *[F.col(f"v.{c}").alias(f"{c}s") for c in ("slot", "low", "last", "high")])

    schema = "row long, slot int, other long, score long"
    begin = materialize(routed(asking(spans.withColumn("last", F.lit(int(_ANY)))), bounds, may(True)))
    first = materialize(streamed(shards, begin, Segments, search, schema))
    raised = (spans.join(_worst(first, ["row", "slot"], n).withColumnRenamed("low", "beat"), ["row", "slot"], "left")
              .select("row", "slot", F.coalesce("beat", "low").alias("low"), F.coalesce("last", F.lit(int(_ANY))).alias("last"), "high"))
    # a few for each group of summaries
    seen = begin.groupBy("row").agg(F.collect_list("to").alias("seen"))
    again = asking(raised).join(seen, "row", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
    second = streamed(shards, routed(materialize(again), bounds, may(False)), Segments, search, schema)
    by = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "other")
    return first.unionByName(second).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def mine(df: DataFrame, anchor_every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors,
    the rows whose id is divisible by ``anchor_every``; ``low`` and ``high`` are per cent of the positive's score."""
    shards = dealt(whole_rows(df, scale, id_col, vec_col, label_col), shard_rows)
    bounds = materialize(summaries(shards, shard_summary, _join_summaries))
    found = materialize(positives(shards, bounds, anchor_every, n_positives))
    span = found.select("row", "slot", F.expr(f"-((-{int(low)} * positive_score) div 100)").alias("l0"),
                        F.expr(f"({int(high)} * positive_score) div 100").alias("h0"), "positive_score")
    # div cuts towards zero: bring both ends inside
    span = span.select("row", "slot", F.expr(f"l0 + cast(l0 * 100 < {int(low)} * positive_score as int)").alias("low"),
                       F.expr(f"h0 - cast(h0 * 100 > {int(high)} * positive_score as int)").alias("high")).where("low <= high")
    held = negatives(shards, bounds, span, n_negatives)
    anchors = shards.select("row", F.col("id").alias("anchor_id")).where(F.col("anchor_id") % anchor_every == 0)
    return (held.join(found, ["row", "slot"]).join(anchors, "row")
            .select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
