"""More fixture checks: cleaning helpers, quotas, threshold scans vs brute force."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from casework.functions import clean
from casework.operators import evaluate, profile, sample


def test_cleaning_helpers(spark):
    df = spark.createDataFrame([(" a ", float("nan"), None), ("", 1.0, "x"), (None, 2.0, "y")],
                               "s string, v double, t string")
    assert [r[0] for r in df.select(clean.has_label("s")).collect()] == [True, False, False]
    assert [r.v for r in clean.nan_to_null(df).collect()] == [None, 1.0, 2.0]
    assert [r.s for r in clean.trim_strings(df).collect()] == ["a", "", None]
    assert clean.complete_cases(clean.nan_to_null(df)).count() == 1
    sp = clean.drop_sparse_columns(df, min_non_null=2)
    assert sp.columns == ["s", "v", "t"]
    assert clean.drop_sparse_columns(df, min_non_null=3).columns == ["v"]


def test_balanced_bags_quotas(spark):
    data = [(i, "R" if i % 5 == 0 else "G") for i in range(1, 201)]
    df = spark.createDataFrame(data, "id long, y string")
    bags = sample.balanced_bags(df, "id", "y", "R", bags=3, ratio=1.0, seed=1)
    cnt = {(r.bag, r.y): r["count"] for r in bags.groupBy("bag", "y").count().collect()}
    assert all(cnt[(b, "R")] == 40 and cnt[(b, "G")] == 40 for b in (1, 2, 3))
    ids = [sorted(r.id for r in bags.where((F.col("bag") == b) & (F.col("y") == "G")).collect())
           for b in (1, 2, 3)]
    assert ids[0] != ids[1]  # different bags draw different rows


def test_precision_threshold_brute_force(spark):
    rnd = random.Random(3)
    data = []
    for _ in range(400):
        p = round(rnd.random(), 7)
        data.append((rnd.choice(["a", "b", "c"]), p, int(rnd.random() < p), rnd.random() < 0.8))
    df = spark.createDataFrame(data, "cls string, p double, hit int, pred boolean")
    for target in (0.6, 0.9):
        got = {r["class"]: r.threshold for r in
               evaluate.precision_threshold(df, "p", "hit", predicted="pred", by="cls", target=target).collect()}
        for c in ("a", "b", "c"):
            rows = [d for d in data if d[0] == c and d[3]]
            best = None
            for t in sorted({round(d[1], 6) for d in rows}):
                m = [d for d in rows if d[1] >= t]
                if m and sum(d[2] for d in m) / len(m) >= target:
                    best = t
                    break
            assert got[c] == best


def test_class_report_manual(spark):
    data = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("C", "A")]
    df = spark.createDataFrame(data, "t string, p string")
    rep = {r.label: r for r in evaluate.class_report(df, "t", "p").collect()}
    assert rep["A"].precision == 0.5 and rep["A"].recall == 0.5 and rep["C"].precision == 0.0
    assert rep["B"].recall == 1.0 and math.isclose(rep["B"].precision, 2 / 3, rel_tol=1e-6)
    assert rep["accuracy"].f1 == 0.6 and rep["accuracy"].support == 5


def test_box_stats_numpy(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 100.0, -50.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    r = profile.box_stats(df, "v", ["g"]).first()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = q3 - q1
    inside = s[(s >= q1 - 1.5 * iqr) & (s <= q3 + 1.5 * iqr)]
    assert r.q1 == round(q1, 6) and r.whisker_lo == inside.min() and r.whisker_hi == inside.max()
    assert r.n_outliers == 2


def test_kde_matches_formula(spark):
    vals = [1.0, 2.0, 2.0, 4.0, 7.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    out = profile.kde_grid(df, "v", ["g"], gridsize=5, decimals=12).orderBy("grid_idx").collect()
    n = len(vals)
    sd = pd.Series(vals).std()
    h = n ** -0.2 * sd
    lo, hi = min(vals) - 3 * h, max(vals) + 3 * h
    for r in out:
        x = lo + r.grid_idx * (hi - lo) / 4
        want = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in vals) / (n * h * math.sqrt(2 * math.pi))
        assert math.isclose(r.density, want, rel_tol=1e-6, abs_tol=1e-12)


def test_crosstab_small(spark):
    df = spark.createDataFrame([("x", "Avslag"), ("x", "Godkjent"), ("x", "Godkjent"), ("y", "Avslag")],
                               "c string, o string")
    got = {(r.value, r.o): (r.n, r.pct) for r in profile.crosstab_pct(df, ["c"], "o").collect()}
    assert got == {("x", "Avslag"): (1, 33.3), ("x", "Godkjent"): (2, 66.7), ("y", "Avslag"): (1, 100.0)}
