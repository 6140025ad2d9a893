"""Profiling operators (D4-D18): value counts, frequencies, crosstabs,
numeric/mixed profiles, correlations, box statistics, densities.

Everything is a grouped aggregate: partial (map-side) aggregation runs
before the shuffle, and windows only ever run over already-aggregated,
small tables (one row per group/value), never over raw rows.  Quantiles come
from the exact distributed ``exact_quantiles`` (no per-group value buffers).
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.operators.quantile import quantile_columns


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def melt(df: DataFrame, cols: list[str], keep: list[str] | None = None,
         name: str = "column_name", value: str = "value", as_string: bool = True) -> DataFrame:
    """Wide -> long over ``cols`` (a narrow ``unpivot``; no shuffle)."""
    keep = list(keep or [])
    t = "string" if as_string else "double"
    sel = df.select(*[_q(k) for k in keep], *[_q(c).cast(t).alias(c) for c in cols])
    return sel.unpivot(keep, cols, name, value)


def value_counts(df: DataFrame, col: str, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """Counts per non-null value (optionally inside groups)."""
    by = list(by or [])
    return (df.where(_q(col).isNotNull()).groupBy(*by, _q(col))
            .agg(F.count(F.lit(1)).alias(name)))


def crosstab_pct(df: DataFrame, category_cols: list[str], outcome: str,
                 weight: str | None = None, decimals: int = 1) -> DataFrame:
    """Row-percent crosstab of each category column against ``outcome``.

    Long form: (column_name, value, <outcome>, n, pct).  ``weight`` lets a
    caller feed pre-aggregated counts.  The window runs over the aggregate
    (one row per column/value/outcome), not over input rows.
    """
    w = _q(weight).cast("long") if weight else F.lit(1).cast("long")
    base = df.select(*[_q(c).cast("string").alias(c) for c in category_cols],
                     _q(outcome).alias(outcome), w.alias("_w"))
    long = base.unpivot([outcome, "_w"], category_cols, "column_name", "value")
    cnt = (long.where(F.col("value").isNotNull())
           .groupBy("column_name", "value", outcome).agg(F.sum("_w").alias("n")))
    tot = Window.partitionBy("column_name", "value")
    return cnt.withColumn(
        "pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(tot), decimals))


def freq_by_outcome(df: DataFrame, cols: list[str], outcome: str, classes: list[str],
                    decimals: int = 6) -> DataFrame:
    """Share of each value among the non-null values of a column inside
    each outcome class; classes side by side, absent -> 0 (no join needed).

    Output: (column_name, value, <class>...).
    """
    long = melt(df, cols, [outcome]).where(F.col("value").isNotNull())
    cnt = long.groupBy("column_name", "value", outcome).agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy("column_name", outcome)
    share = cnt.withColumn("share", F.col("n") / F.sum("n").over(tot))
    return share.groupBy("column_name", "value").agg(*[
        F.round(F.coalesce(F.max(F.when(F.col(outcome) == F.lit(k), F.col("share"))),
                           F.lit(0.0)), decimals).alias(k) for k in classes])


_PROBS = (0.25, 0.5, 0.75)
_QNAMES = ["p25", "p50", "p75"]


def _grouped(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows without a group take no part in a grouped profile."""
    return df.dropna("any", subset=by) if by else df


def profile_numeric(df: DataFrame, cols: list[str], by: list[str] | None = None,
                    decimals: int | None = 6) -> DataFrame:
    """describe() per group and column in long form:
    (by..., column_name, count, mean, std, min, p25, p50, p75, max).
    ``std`` is the sample standard deviation; quantiles are linear."""
    by = list(by or [])
    long = melt(_grouped(df, by), cols, by, as_string=False).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    keys = by + ["column_name"]
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = quantile_columns(long, "value", keys, _PROBS, _QNAMES)
    out = basic.join(qs, keys, "left")
    r = (lambda c: F.round(F.col(c), decimals)) if decimals is not None else F.col
    return out.select(*keys, F.col("count").cast("long").alias("count"),
                      *[r(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def profile_text(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """D8 (text part): count, unique, top, freq per group and column.
    ``top`` = most frequent value, the smallest one on ties (deterministic)."""
    by = list(by or [])
    long = melt(_grouped(df, by), cols, by).where(F.col("value").isNotNull())
    keys = by + ["column_name"]
    vc = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v")))
    return vc.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"),
        best.alias("_b")).select(*keys, "count", "unique", F.col("_b.v").alias("top"),
                                 (-F.col("_b.neg_n")).cast("long").alias("freq"))


def profile_mixed(df: DataFrame, num_cols: list[str], text_cols: list[str],
                  by: list[str] | None = None, decimals: int | None = 6) -> DataFrame:
    """describe(include='all') in long form, numeric and text rows together."""
    by = list(by or [])
    n = profile_numeric(df, num_cols, by, decimals)
    t = profile_text(df, text_cols, by)
    # unique/freq exist for text rows only: double keeps the NULLs plain
    t = t.withColumn("unique", F.col("unique").cast("double")).withColumn(
        "freq", F.col("freq").cast("double"))
    return n.unionByName(t, allowMissingColumns=True)


def confusion_subsets(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Tag each row with its truth=pred cell and its prediction margin
    (two rows per input row: a bounded, narrow explode)."""
    return df.where(_q(truth).isNotNull() & _q(pred).isNotNull()).withColumn(
        "subset", F.explode(F.array(
            F.concat(_q(truth), F.lit("="), _q(pred)),
            F.concat(F.lit("Predikert "), _q(pred)))))


def profile_by_confusion(df: DataFrame, truth: str, pred: str, num_cols: list[str],
                         text_cols: list[str], count_col: str | None = None,
                         decimals: int | None = 6) -> tuple[DataFrame, DataFrame | None]:
    """Profiles for the four truth x prediction cells and the two
    prediction margins.  Each row is tagged with both of its subsets (explode of
    a two-element array), so one grouped pass covers overlapping subsets.
    Returns (profile, value counts of ``count_col`` per subset)."""
    tagged = confusion_subsets(df, truth, pred)
    prof = profile_mixed(tagged, num_cols, text_cols, ["subset"], decimals)
    counts = value_counts(tagged, count_col, ["subset"]) if count_col else None
    return prof, counts


def cardinality_gate(df: DataFrame, cols: list[str], max_distinct: int = 50) -> DataFrame:
    """Which text columns are label-encoded (<= ``max_distinct`` values).
    Output: (column_name, n_distinct, encode)."""
    long = melt(df, cols)
    d = long.where(F.col("value").isNotNull()).groupBy("column_name").agg(
        F.count_distinct("value").alias("n_distinct"))
    return d.select("column_name", d.n_distinct.cast("long").alias("n_distinct"),
                    (d.n_distinct <= max_distinct).alias("encode"))


def encode_gate(df: DataFrame, cols: list[str], max_distinct: int = 50) -> DataFrame:
    """D10, the decision alone: (column_name, encode) of every column with a
    value.

    One scan and one theta sketch for each column; a sketch of at least twice
    ``max_distinct`` hashes counts exactly up to its size and reports more
    beyond, so the decision is that of the exact count.  Sketches merge map-side,
    and no values are exchanged."""
    size = max(12, math.ceil(math.log2(2 * max_distinct + 2)))
    if size > 26:
        raise ValueError("encode_gate holds its limit in one sketch: max_distinct goes up to 2^25 - 1")
    # a sketch passes over empty texts, so every value gets a letter in front
    row = df.agg(*[F.theta_sketch_agg(F.concat(F.lit("v"), _q(c).cast("string")), size).alias(f"c{i}") for i, c in enumerate(cols)])
    n = [F.theta_sketch_estimate(f"c{i}") for i in range(len(cols))]
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), (x <= max_distinct).alias("encode"), (x > 0).alias("any"))
                     for c, x in zip(cols, n, strict=True)])
    return row.select(F.explode(each).alias("s")).where("s.any").select("s.column_name", "s.encode")


def corr_matrix(df: DataFrame, cols: list[str], decimals: int = 6) -> DataFrame:
    """Pearson correlation of every column pair over complete cases.
    One aggregate computes the upper triangle; the result is mirrored and the
    diagonal added.  A column without spread has no correlation, not even with
    itself (NULL).  Output: (col_a, col_b, corr)."""
    cc = df.select(*[_q(c).cast("double").alias(c) for c in cols]).dropna("any")
    pairs = list(combinations(range(len(cols)), 2))
    # a column is constant if min = max: rounding in the variance plays no part
    row = cc.agg(*[(F.min(_q(c)) < F.max(_q(c))).alias(f"v{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.covar_pop(_q(cols[a]), _q(cols[b])).alias(f"c{a}_{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        both = F.col(f"v{a}") & F.col(f"v{b}")
        r = F.when(both, F.try_divide(F.col(f"c{a}_{b}"), F.col(f"s{a}") * F.col(f"s{b}")))
        cells += [(cols[a], cols[b], r), (cols[b], cols[a], r)]
    cells += [(c, c, F.when(F.col(f"v{i}"), F.lit(1.0))) for i, c in enumerate(cols)]
    out = row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("corr"))
        for a, b, r in cells])).alias("s")).select("s.*")
    return out.withColumn("corr", F.round("corr", decimals))


def top_mean_diff(df: DataFrame, cols: list[str], group: str, a: str, b: str,
                  k: int = 5, decimals: int = 6) -> DataFrame:
    """The ``k`` columns whose means differ most between groups ``a`` and
    ``b``: (column_name, mean_<a>, mean_<b>, abs_diff).  Top-k is the feature."""
    long = melt(df, cols, [group], as_string=False)
    m = long.groupBy("column_name").agg(
        F.avg(F.when(_q(group) == F.lit(a), F.col("value"))).alias(f"mean_{a}"),
        F.avg(F.when(_q(group) == F.lit(b), F.col("value"))).alias(f"mean_{b}"))
    m = m.withColumn("abs_diff", F.abs(F.col(f"mean_{a}") - F.col(f"mean_{b}")))
    m = m.where(F.col("abs_diff").isNotNull()).orderBy(F.desc("abs_diff"), "column_name").limit(k)
    return m.select("column_name", *[F.round(c, decimals).alias(c)
                                     for c in [f"mean_{a}", f"mean_{b}", "abs_diff"]])


def score_quantiles(df: DataFrame, score: str, by: list[str] | None = None,
                    probs=_PROBS, names=_QNAMES) -> DataFrame:
    """Quantiles of a score (linear interpolation)."""
    return quantile_columns(df, score, by, probs, names)


def facet_options(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct non-null values per facet, long form (facet, value)."""
    return (melt(df, cols, name="facet").where(F.col("value").isNotNull())
            .select("facet", "value").distinct())


def facet_bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    """Integer slider bounds per numeric facet (truncated like ``int``)."""
    long = melt(df, cols, name="facet", as_string=False)
    return long.groupBy("facet").agg(
        F.min("value").cast("long").alias("lo"), F.max("value").cast("long").alias("hi"))


def box_stats(df: DataFrame, value: str, by: list[str], whisker: float = 1.5,
              decimals: int = 6) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends (extreme values inside the
    fences) and outlier counts per group."""
    q = quantile_columns(df, value, by, _PROBS, ["q1", "median", "q3"])
    v = df.select(*[_q(c) for c in by], _q(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())
    j = v.join(q.withColumn("_iqr", F.col("q3") - F.col("q1")), by)
    lo = F.col("q1") - F.lit(whisker) * F.col("_iqr")
    hi = F.col("q3") + F.lit(whisker) * F.col("_iqr")
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    agg = j.groupBy(*by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.count_if(~inside).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).cast("long").alias("n"))
    return agg.select(*by, *[F.round(c, decimals).alias(c) for c in
                             ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                      "n_outliers", "n")


#: terms of the expansion around the middle of a bin that is half a bandwidth wide: what is left out is
#: below 1.09 * 0.25^16 / sqrt(16!) * 1.1 < 7e-17 of one value's peak (Cramer's bound on Hermite polynomials)
_KDE_TERMS = 16


def kde_grid(df: DataFrame, value: str, by: list[str], gridsize: int = 200,
             cut: float = 3.0, decimals: int = 8) -> DataFrame:
    """Gaussian KDE per group on a ``gridsize``-point grid.

    Scott bandwidth h = n^(-1/5) * sample std; grid from min - cut*h to
    max + cut*h.  With s the distance of a value from the middle of its bin
    and t that of the grid point, both in bandwidths, exp(-(t-s)^2/2) =
    exp(-t^2/2) * sum of He_k(t) * s^k/k!: each bin of half a bandwidth keeps
    the sums of s^k/k! over its values, and only bins meet grid points, so the
    work does not grow with the distinct values.  The terms left out stay
    below 7e-17 of the kernel's peak (``_KDE_TERMS``).
    Output: (by..., grid_idx, x, density)."""
    v = df.select(*[_q(c) for c in by], _q(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    st = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"),
                            F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    st = st.withColumn("_h", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_sd")) \
           .where(F.col("_h") > 0)
    st = st.withColumn("_g0", F.col("_mn") - F.lit(cut) * F.col("_h")).withColumn(
        "_step", (F.col("_mx") - F.col("_mn") + F.lit(2 * cut) * F.col("_h")) / F.lit(gridsize - 1))
    # one row for each group; Spark broadcasts it by its size
    j = v.join(st.select(*by, "_n", "_h", "_mn", "_g0", "_step"), by)
    half = F.col("_h") / 2
    j = j.withColumn("_bin", F.floor((F.col("_v") - F.col("_mn")) / half)) \
         .withColumn("_mid", F.col("_mn") + (F.col("_bin") + 0.5) * half) \
         .withColumn("_s", (F.col("_v") - F.col("_mid")) / F.col("_h"))
    bins = j.groupBy(*by, "_n", "_h", "_g0", "_step", "_mid").agg(
        *[F.sum(F.pow("_s", F.lit(float(k))) / float(math.factorial(k))).alias(f"_m{k}") for k in range(_KDE_TERMS)])
    pair = bins.withColumn("grid_idx", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
    pair = pair.withColumn("x", F.col("_g0") + F.col("grid_idx") * F.col("_step")).withColumn(
        "_t", (F.col("x") - F.col("_mid")) / F.col("_h"))
    # He_0 = 1, He_(k+1) = t He_k - k He_(k-1)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))
    series = F.aggregate(F.array(*[F.col(f"_m{k}") for k in range(_KDE_TERMS)]), start, lambda acc, m: F.struct(
        acc["b"].alias("a"), (F.col("_t") * acc["b"] - acc["k"] * acc["a"]).alias("b"),
        (acc["k"] + 1.0).alias("k"), (acc["s"] + m * acc["b"]).alias("s")), lambda acc: acc["s"])
    # beyond 38.6 bandwidths exp(-t^2/2) is zero in a double
    near = F.when(F.abs("_t") < 39.0, F.exp(F.lit(-0.5) * F.col("_t") * F.col("_t")) * series).otherwise(F.lit(0.0))
    dens = pair.groupBy(*by, "grid_idx", "x", "_n", "_h").agg(F.sum(near).alias("_s"))
    out = dens.select(*by, "grid_idx", "x", (F.col("_s") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))))
                      .alias("density"))
    return out.select(*by, "grid_idx", F.round("x", 6).alias("x"),
                      F.round("density", decimals).alias("density"))


def histogram_density(df: DataFrame, value: str, group: str, bins: int = 20,
                      decimals: int = 8) -> DataFrame:
    """Density histogram per group on common bins over the global range.
    Output: (group, bin, lo, hi, n, density), density = n/(n_group * width), empty bins included."""
    v = df.select(_q(group), _q(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & _q(group).isNotNull())
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    # the global range as scalar subqueries (no join)
    j = v.withColumn("_mn", v.select(F.min("_v")).scalar()).withColumn("_mx", v.select(F.max("_v")).scalar())
    j = j.withColumn("bin", F.when(w > 0, F.least(F.floor((F.col("_v") - F.col("_mn")) / w),
                                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
    c = j.groupBy(_q(group), "bin", "_mn", "_mx").agg(F.count(F.lit(1)).alias("n"))
    # every group has every bin, with 0 where it has no value
    per = c.groupBy(_q(group), "_mn", "_mx").agg(F.sum("n").alias("_tot"), F.map_from_entries(
        F.collect_list(F.struct("bin", "n"))).alias("_by"))          # at most ``bins`` entries
    full = per.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = full.withColumn("n", F.coalesce(F.element_at("_by", F.col("bin")), F.lit(0))) \
               .withColumn("_w", (F.col("_mx") - F.col("_mn")) / F.lit(bins))
    full = full.withColumn("density", F.try_divide(F.col("n"), F.col("_tot") * F.col("_w")))
    return full.select(_q(group), "bin", F.round(F.col("_mn") + F.col("bin") * F.col("_w"), decimals).alias("lo"),
                       F.round(F.col("_mn") + (F.col("bin") + 1) * F.col("_w"), decimals).alias("hi"),
                       F.col("n").cast("long").alias("n"), F.round("density", decimals).alias("density"))
