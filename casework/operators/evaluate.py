"""Evaluation and threshold selection.

Confusion counts are one grouped aggregate; reports are arithmetic on those
counts.  Threshold scans never pair candidates with rows: E6/E7 use the
sort-based ``prefix_sums`` over pre-aggregated (class, p) counts, and E8
explodes a fixed 17-value grid over pre-aggregated (p, label) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.operators.quantile import prefix_sums


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _grid(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small literal table (label grids, threshold grids)."""
    return spark.createDataFrame(rows, schema)


def confusion(df: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    """Labels x labels confusion counts, zero-filled, in the given label
    order; rows whose truth or prediction is not a listed label are ignored.
    Output: (truth, pred, truth_idx, pred_idx, n)."""
    spark = df.sparkSession
    cnt = (df.where(_q(truth).isin(*labels) & _q(pred).isin(*labels))
           .groupBy(_q(truth).alias("truth"), _q(pred).alias("pred"))
           .agg(F.count(F.lit(1)).alias("n")))
    grid = _grid(spark, [(a, b, i, j) for i, a in enumerate(labels) for j, b in enumerate(labels)],
                 "truth string, pred string, truth_idx int, pred_idx int")
    return (F.broadcast(grid).join(cnt, ["truth", "pred"], "left")
            .select("truth", "pred", "truth_idx", "pred_idx",
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def class_report(df: DataFrame, truth: str, pred: str, labels: list[str] | None = None,
                 decimals: int = 6) -> DataFrame:
    """Per-class precision, recall, F1 and support, then accuracy, macro
    and weighted averages; 0 where a ratio's denominator is 0.

    Without ``labels`` the classes are all values seen in truth or prediction.
    Output: (label, precision, recall, f1, support) - the accuracy row carries
    the accuracy in ``f1`` (NULL precision/recall), as the usual text report.
    """
    base = df.where(_q(truth).isNotNull() & _q(pred).isNotNull())
    if labels is not None:
        base = base.where(_q(truth).isin(*labels) | _q(pred).isin(*labels))
    tag = base.select(F.explode(F.array(
        F.struct(_q(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (_q(truth) == _q(pred)).cast("int").alias("tp")),
        F.struct(_q(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(0).alias("tp")))).alias("s")).select("s.*")
    per = tag.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("npred"),
                                   F.sum("tp").alias("tp"))
    if labels is not None:
        per = per.where(F.col("label").isin(*labels))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.select("label", prec.alias("precision"), rec.alias("recall"),
                     F.col("support").cast("long").alias("support"), "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall") /
                                      (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    tot = per.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    def row(label, p, r, f):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        F.col("n").cast("long").alias("support"))
    acc = F.coalesce(F.try_divide(F.col("tp"), F.col("n")), F.lit(0.0))
    summary = tot.select(F.explode(F.array(
        row("accuracy", F.lit(None), F.lit(None), acc),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))).alias("s")).select("s.*")
    out = per.select("label", "precision", "recall", "f1", "support").unionByName(summary)
    return out.select("label", *[F.round(c, decimals).alias(c) for c in ["precision", "recall", "f1"]],
                      "support")


def class_ratio(df: DataFrame, label: str, positive=1) -> DataFrame:
    """Negatives / positives (the boosting weight), with both counts."""
    a = df.agg(F.count_if(_q(label) == F.lit(positive)).alias("n_pos"),
               F.count_if(_q(label) != F.lit(positive)).alias("n_neg"))
    return a.select(F.col("n_neg").cast("long").alias("n_neg"),
                    F.col("n_pos").cast("long").alias("n_pos"),
                    F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("ratio"))


def argmax_class(probs, classes: list[str]) -> tuple[Column, Column]:
    """E5: (class, probability) of the largest entry; first class on ties."""
    arr = F.col(probs) if isinstance(probs, str) else probs
    mx = F.array_max(arr)
    idx = F.array_position(arr, mx)
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, idx.cast("int")), mx


def precision_threshold(df: DataFrame, p: str, hit: str, predicted: str | None = None,
                        by: str | None = None, target: float = 0.99,
                        decimals: int = 6, bucket_width: float = 0.001,
                        classes: DataFrame | None = None) -> DataFrame:
    """Smallest candidate threshold whose precision reaches ``target``.

    Candidates are the distinct ``round(p, decimals)`` among rows predicted as
    the class; precision at t uses rows predicted as the class with raw
    ``p >= t``; coverage = that count / all rows of the evaluation set (for E7:
    the whole set, not the class).  Coverage falls as t rises, so the largest
    coverage is the smallest qualifying t.  None qualifies -> NULL threshold.

    Output: (class, threshold, precision, coverage, n_auto).
    """
    key = by or "_cls"
    base = df if by else df.withColumn("_cls", F.lit("*"))
    total = base.select(F.count(F.lit(1))).scalar()
    pred = base.where(_q(predicted)) if predicted else base
    pts = (pred.select(_q(key).alias("class"), (-_q(p).cast("double")).alias("neg_p"),
                       F.lit(1.0).alias("n"), _q(hit).cast("double").alias("hits"))
           .where(F.col("neg_p").isNotNull())
           .groupBy("class", "neg_p").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")))
    cand = (pred.select(_q(key).alias("class"), F.round(_q(p).cast("double"), decimals).alias("t"))
            .where(F.col("t").isNotNull()).distinct()
            .withColumn("neg_p", -F.col("t"))
            .withColumn("qid", F.struct("class", "t")))
    ps = prefix_sums(pts, cand, ["class"], "neg_p", ["n", "hits"], "qid",
                     bucket_width=bucket_width)
    ev = ps.select(F.col("qid.class").alias("class"), F.col("qid.t").alias("t"), "n", "hits")
    # the evaluation-set size is a scalar subquery (no join)
    ev = ev.withColumn("_n_all", total)
    ev = ev.where(F.col("n") > 0).withColumn("precision", F.col("hits") / F.col("n")) \
           .withColumn("coverage", F.col("n") / F.col("_n_all"))
    ok = ev.where(F.col("precision") >= F.lit(target))
    best = ok.groupBy("class").agg(F.min(F.struct("t", "precision", "coverage", "n")).alias("b"))
    best = best.select("class", F.col("b.t").alias("threshold"),
                       F.col("b.precision").alias("precision"), F.col("b.coverage").alias("coverage"),
                       F.col("b.n").cast("long").alias("n_auto"))
    if not by:
        # one class: a global aggregate always yields exactly one row (no join)
        one = ok.agg(F.min(F.struct("t", "precision", "coverage", "n")).alias("b"))
        return one.select(F.col("b.t").alias("threshold"), F.round("b.precision", decimals).alias("precision"),
                          F.round("b.coverage", decimals).alias("coverage"),
                          F.coalesce(F.col("b.n"), F.lit(0)).cast("long").alias("n_auto"))
    names = classes if classes is not None else pred.select(_q(key).alias("class")).distinct()
    out = names.join(best, "class", "left")
    return out.select("class", "threshold", F.round("precision", decimals).alias("precision"),
                      F.round("coverage", decimals).alias("coverage"),
                      F.coalesce("n_auto", F.lit(0)).cast("long").alias("n_auto"))


# 17 evenly spaced thresholds from 0.1 to 0.9 (last one exact),
# NPV and recall floors, fallback threshold.
GRID_THRESHOLDS = [0.1 + i * 0.05 for i in range(16)] + [0.9]
GRID_FLOORS = (0.6, 0.6)
GRID_FALLBACK = 0.5


def grid_threshold(df: DataFrame, p: str, label: str, thresholds=GRID_THRESHOLDS,
                   npv_floor: float = GRID_FLOORS[0], recall_floor: float = GRID_FLOORS[1],
                   fallback: float = GRID_FALLBACK) -> DataFrame:
    """Threshold on a fixed grid that maximises (recall + NPV)/2 subject to
    NPV >= floor and recall >= floor; the first (smallest) wins ties; none ->
    ``fallback`` with NULL score.  Counts per grid value come from one
    aggregate over the (p, label) counts exploded against the 17 literals.
    Output: (threshold, score, npv, recall)."""
    agg = df.select(_q(p).cast("double").alias("p"), _q(label).cast("int").alias("y")) \
            .groupBy("p", "y").agg(F.count(F.lit(1)).alias("c"))
    g = agg.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    pos = F.col("p") >= F.col("t")
    cm = g.groupBy("t").agg(
        F.sum(F.when(pos & (F.col("y") == 1), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(~pos & (F.col("y") == 1), F.col("c")).otherwise(0)).alias("fn"),
        F.sum(F.when(~pos & (F.col("y") != 1), F.col("c")).otherwise(0)).alias("tn"))
    npv = F.coalesce(F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fn")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    sc = cm.select("t", npv.alias("npv"), rec.alias("recall"))
    sc = sc.withColumn("score", (F.col("recall") + F.col("npv")) / 2)
    ok = sc.where((F.col("npv") >= npv_floor) & (F.col("recall") >= recall_floor))
    best = ok.agg(F.max(F.struct("score", (-F.col("t")).alias("neg_t"), "npv", "recall")).alias("b"))
    return best.select(F.coalesce(-F.col("b.neg_t"), F.lit(float(fallback))).alias("threshold"),
                       F.round("b.score", 6).alias("score"), F.round("b.npv", 6).alias("npv"),
                       F.round("b.recall", 6).alias("recall"))
