"""Exact, distributed quantiles and prefix counts.

``exact_quantiles`` gives linear-interpolated quantiles (the definition of
Spark ``percentile`` / DuckDB ``quantile_cont``) without collecting a group's
values into one aggregation buffer:

1. one pass for each group's count and, from a bounded sketch, a bracket of
   values around every target rank (a few ten-thousandths of the rows);
2. one pass that counts the rows between brackets as one number each and the
   distinct values inside brackets one by one;
3. cumulative counts over that small table locate the two values around each
   target rank, which are interpolated.

The brackets follow the data, so an outlier far from the bulk moves none.  A
rank outside its bracket would raise an error, never give a wrong value.

``prefix_sums`` answers "sum of weights of points at or below a position"
for many query positions in one sort-based pass (no point pairs emitted);
it is the building block of the proximity count (C5) and threshold scans (E6).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.session import few_rows, materialize

#: buckets in one block of offsets
_BLOCK = 1024


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def exact_quantiles(df: DataFrame, value: str, by: list[str] | None = None,
                    probs=(0.25, 0.5, 0.75), accuracy: int = 10_000,
                    prob_col: str = "prob", out_col: str = "quantile") -> DataFrame:
    """(by..., prob, quantile) for every group with at least one non-null value."""
    by = list(by or [])
    if not by:
        # one global group; the key is computed from a column so the optimizer
        # keeps the joins as equi-joins (a literal key would be folded away)
        key = F.regexp_replace(F.coalesce(_q(value).cast("string"), F.lit("")), "^.*$", "0")
        q = exact_quantiles(df.withColumn("_all", key), value, ["_all"], probs,
                            accuracy, prob_col, out_col)
        return q.drop("_all")
    v = df.select(*[_q(c) for c in by], _q(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    slack = 5.0 / accuracy
    cuts = [x for p in probs for x in (p - slack, p + slack)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, x))) for x in cuts]), F.lit(accuracy))
    stats = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_cut"))
    # open brackets reach to the ends of the range
    lows = [F.lit(float("-inf")) if p - slack <= 0 else F.col("_cut")[2 * i] for i, p in enumerate(probs)]
    highs = [F.lit(float("inf")) if p + slack >= 1 else F.col("_cut")[2 * i + 1] for i, p in enumerate(probs)]
    j = v.join(few_rows(stats), by)  # one row for each group; a group's rows stay where they are
    inside = reduce(lambda x, y: x | y, [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b in zip(lows, highs, strict=True)])
    # grows with the value: the same place means the same brackets
    place = sum([(F.col("_v") >= a).cast("int") + (F.col("_v") > b).cast("int") for a, b in zip(lows, highs, strict=True)], F.lit(0))
    # in a small group a rank is a large share of the rows: all its values count one by one
    small = F.col("_n") <= F.lit(4 * accuracy)
    few = (j.select(*[_q(c) for c in by], "_n", F.when(small, 0).otherwise(place).alias("_p"),
                    F.when(small | inside, F.col("_v")).alias("_w"))
           .groupBy(*by, "_n", "_p", "_w").agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy(*by).orderBy("_p", "_w").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    # the lower rank's value and, past it, the upper rank's
    pos = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]

    def holds(k):
        hit = (k >= F.col("_start")) & (k < F.col("_end"))
        found = F.when(F.col("_w").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(F.col("_w"))
        return F.max(F.when(hit, found))

    row = few.groupBy(*by).agg(F.max("_n").alias("_n"), *[x for i, p in enumerate(pos) for x in (
        holds(F.floor(p)).alias(f"_a{i}"), holds(F.least(F.floor(p) + 1, F.col("_n") - 1)).alias(f"_b{i}"))])
    values = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}"))
                                                             * (pos[i] - F.floor(pos[i]))).alias("q"))
                       for i, p in enumerate(probs)])
    return (row.select(*[_q(c) for c in by], F.explode(values).alias("_x"))
            .select(*[_q(c) for c in by], F.col("_x.p").alias(prob_col), F.col("_x.q").alias(out_col)))


def quantile_columns(df: DataFrame, value: str, by: list[str] | None, probs,
                     names: list[str], **kw) -> DataFrame:
    """Quantiles pivoted to one column per prob: (by..., names...)."""
    by = list(by or [])
    q = exact_quantiles(df, value, by, probs, **kw)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
            for p, n in zip(probs, names)]
    return q.groupBy(*by).agg(*aggs)


def prefix_sums(points: DataFrame, queries: DataFrame, keys: list[str], pos: str,
                weights: list[str], qid: str, strict: str | None = None,
                bucket_width: float = 500.0) -> DataFrame:
    """For each query row: sum of point weights with the same keys and
    ``point.pos <= query.pos`` (``< `` when the query's ``strict`` flag is true).

    Points and queries are unioned, exchanged once and sorted by (keys, bucket,
    pos, tie); the running sums go to the checkpoint folder, and the last one of
    each bucket gives the buckets' offsets, in two levels (buckets within a
    block of ``_BLOCK``, then blocks), which finish the count.  Output: (qid, weights...).  No
    point pairs are materialised; callers pass one row for each distinct
    position, so ``bucket_width`` bounds the rows of a bucket.
    """
    wcols = list(weights)
    p = points.select(*[_q(k) for k in keys], _q(pos).cast("double").alias("_pos"),
                      *[_q(w).cast("double").alias(w) for w in wcols]) \
              .where(F.col("_pos").isNotNull())
    bucket = F.floor(F.col("_pos") / F.lit(float(bucket_width))).cast("long")
    p = p.withColumn("_b", bucket)
    qs = queries.select(*[_q(k) for k in keys], _q(pos).cast("double").alias("_pos"),
                        _q(qid).alias("_qid"),
                        (F.coalesce(_q(strict), F.lit(False)) if strict else F.lit(False))
                        .alias("_strict")).where(F.col("_pos").isNotNull()).withColumn("_b", bucket)
    # strict queries sort before points at the same position, others after
    zero = F.lit(0.0)
    none = F.lit(None).cast(queries.schema[qid].dataType)
    u = (p.select(*keys, "_b", "_pos", none.alias("_qid"), F.lit(1).alias("_tie"), *wcols)
         .unionByName(qs.select(*keys, "_b", "_pos", "_qid", F.when(F.col("_strict"), 0).otherwise(2).alias("_tie"),
                                *[zero.alias(w) for w in wcols])))
    order = Window.partitionBy(*keys, "_b").orderBy("_pos", "_tie")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    # points and queries are read, exchanged and sorted once; a bucket's last row holds its total
    ran = materialize(u.select(*keys, "_b", "_qid", F.lead(F.lit(True)).over(order).isNull().alias("_last"),
                               *[F.sum(w).over(run).alias("_r_" + w) for w in wcols])
                      .where("_last or _qid is not null"))
    # the weight before each bucket, in two levels: within blocks of buckets, then over the blocks of a key
    held = (ran.where("_last").select(*keys, "_b", F.floor(F.col("_b") / _BLOCK).alias("_k"), *[F.col("_r_" + w).alias(w) for w in wcols]))
    inner = Window.partitionBy(*keys, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (held.groupBy(*keys, "_k").agg(*[F.sum(w).alias(w) for w in wcols])
              .select(*keys, "_k", *[F.coalesce(F.sum(w).over(outer), zero).alias("_o_" + w) for w in wcols]))
    offsets = (held.select(*keys, "_b", "_k", *[F.coalesce(F.sum(w).over(inner), zero).alias("_i_" + w) for w in wcols])
               .join(blocks, [*keys, "_k"])
               .select(*keys, "_b", *[(F.col("_i_" + w) + F.col("_o_" + w)).alias("_o_" + w) for w in wcols]))
    own = ran.where("_qid is not null").drop("_last")
    return own.join(offsets, [*keys, "_b"]).select(
        F.col("_qid").alias(qid), *[(F.col("_o_" + w) + F.col("_r_" + w)).alias(w) for w in wcols])
