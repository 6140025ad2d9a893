"""Property tests (hypothesis): the distributed operators equal brute force
on random small inputs, including duplicates and boundary distances."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.operators import enrich, quantile

positions = st.lists(st.tuples(st.sampled_from(["A", "B"]),
                               st.one_of(st.integers(0, 40).map(lambda x: x * 12.5),
                                         st.floats(0, 500, allow_nan=False))),
                     min_size=1, max_size=40)


@settings(max_examples=8, deadline=None)
@given(pts=positions, cases=positions, radius=st.sampled_from([25.0, 37.5, 100.0]))
def test_count_within_equals_brute_force(spark, pts, cases, radius):
    p = spark.createDataFrame(pts, "k string, x double")
    c = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(cases)], "id long, k string, x double")
    got = {r.id: r.n_within for r in enrich.count_within(c, p, "k", "x", "k", "x", radius,
                                                           bucket_width=radius / 3).collect()}
    for i, (k, x) in enumerate(cases):
        assert got[i] == sum(1 for kk, xx in pts if kk == k and abs(xx - x) <= radius)


values = st.lists(st.tuples(st.sampled_from(["g1", "g2"]),
                            st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False))),
                  min_size=1, max_size=60)


@settings(max_examples=8, deadline=None)
@given(vals=values)
def test_exact_quantiles_equal_pandas(spark, vals):
    df = spark.createDataFrame(vals, "g string, v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r.g, r.prob): r.quantile for r in quantile.exact_quantiles(df, "v", ["g"], probs, accuracy=100).collect()}
    pdf = pd.DataFrame(vals, columns=["g", "v"])
    for g, sub in pdf.groupby("g"):
        for p in probs:
            want = sub.v.quantile(p)
            assert abs(got[(g, p)] - want) <= 1e-9 * max(1.0, abs(want))


labels = st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.sampled_from(["A", "B", "D"])),
                  min_size=1, max_size=50)


@settings(max_examples=6, deadline=None)
@given(pairs=labels)
def test_class_report_equals_manual(spark, pairs):
    from casework.operators import evaluate
    df = spark.createDataFrame(pairs, "t string, p string")
    got = {r.label: r for r in evaluate.class_report(df, "t", "p").collect()}
    labs = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    n = len(pairs)
    precs, recs, f1s, sups = [], [], [], []
    for lab in labs:
        tp = sum(1 for t, p in pairs if t == lab and p == lab)
        npred = sum(1 for _, p in pairs if p == lab)
        sup = sum(1 for t, _ in pairs if t == lab)
        pr = tp / npred if npred else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        assert abs(got[lab].precision - pr) < 1e-6 and abs(got[lab].recall - rc) < 1e-6
        assert abs(got[lab].f1 - f1) < 1e-6 and got[lab].support == sup
        precs.append(pr); recs.append(rc); f1s.append(f1); sups.append(sup)
    acc = sum(1 for t, p in pairs if t == p) / n
    assert abs(got["accuracy"].f1 - acc) < 1e-6 and got["accuracy"].support == n
    assert abs(got["macro avg"].f1 - sum(f1s) / len(f1s)) < 1e-6
    assert abs(got["weighted avg"].recall - sum(r * s for r, s in zip(recs, sups)) / n) < 1e-6
