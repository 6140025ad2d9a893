"""Hot-key fixtures: one key holds a third or more of all rows.  Results must
stay exact and whole (nothing dropped or sampled)."""

import math
import random
import re

import pytest

import pandas as pd
from pyspark.sql import functions as F

from casework.operators import enrich, quantile, sample


def test_count_within_hot_road(spark):
    rnd = random.Random(5)
    pts = [("HOT", round(rnd.uniform(0, 3000), 1)) for _ in range(900)] + \
          [(f"R{i}", round(rnd.uniform(0, 3000), 1)) for i in range(600)] + [("HOT", 1500.0)] * 300
    cases = [(i, "HOT", round(rnd.uniform(0, 3000), 1)) for i in range(200)] + [(999, "HOT", 1500.0)]
    p = spark.createDataFrame(pts, "road string, m double")
    c = spark.createDataFrame(cases, "id long, road string, m double")
    got = {r.id: r.n_within for r in enrich.count_within(c, p, "road", "m", "road", "m", 250.0).collect()}
    for cid, road, m in cases:
        assert got[cid] == sum(1 for r, x in pts if r == road and abs(x - m) <= 250), cid


@pytest.mark.parametrize("key_rows", [enrich._KEY_ROWS, 200, 0])
def test_count_within_of_short_and_long_roads(spark, monkeypatch, key_rows):
    """Short roads are sorted in one exchange, long ones in buckets; the counts are those of all pairs."""
    monkeypatch.setattr(enrich, "_KEY_ROWS", key_rows)
    rnd = random.Random(6)
    road = lambda: rnd.choice(["HOT", "HOT", *[f"R{i}" for i in range(30)], None])
    place = lambda: rnd.choice([None, float("nan"), float("inf"), -0.0, 0.0, *[round(rnd.uniform(-900, 900), 1) for _ in range(40)]])
    pts = [("HOT", round(rnd.uniform(0, 900), 1)) for _ in range(300)] + [
        (r, x) for r, x in ((road(), place()) for _ in range(900)) if x is None or x == x]
    cases = [(i // 2, road(), place()) for i in range(400)] + [(7, "HOT", 100.0)] * 3
    p = spark.createDataFrame(pts, "road string, m double")
    c = spark.createDataFrame(cases, "id long, road string, m double").withColumn("map", F.create_map("id", "road"))
    got = enrich.count_within(c, p, "road", "m", "road", "m", 250.0)
    assert got.columns == ["id", "road", "m", "map", "n_within"] and dict(got.dtypes)["n_within"] == "bigint"
    if key_rows > 1000:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") - plan.count("Subquery") <= 2  # printed in the initial plan only
    want = [(i, r, str(x), sum(1 for q, y in pts if q is not None and q == r and x is not None and y is not None and abs(y - x) <= 250))
            for i, r, x in cases]
    assert sorted(((r.id, r.road, str(r.m), r.n_within) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("upper", [True, False])
def test_bounds_are_exact_and_compiled(spark, upper):
    """The outermost of all candidates, by methods short enough for the compiler."""
    rnd = random.Random(7)
    xs = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e20, -499.99, 1e-9, *[round(rnd.uniform(-1e5, 1e5), 2) for _ in range(300)]]
    df = spark.createDataFrame([(x,) for x in xs], "m double")
    got = enrich._with_exact_bound(df, "m", 500.1, upper, "b")
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(got._jdf.queryExecution(), "codegen")
    assert max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 2500
    for row in got.collect():
        m, best = row.m, None
        if m is not None and math.isfinite(m):
            t = m + 500.1 if upper else m - 500.1
            u = 2.0 ** (math.floor(math.log2(abs(t) + 1e-300)) - 53)
            ok = [c for c in (t + k * u for k in range(-8, 9)) if abs(c - m) <= 500.1]
            best = (max(ok) if upper else min(ok)) if ok else None
        assert row.b == best, m


def test_quantiles_hot_group_and_value(spark):
    data = [("hot", 1.0)] * 2000 + [("hot", float(i)) for i in range(1000)] + [("cold", float(i)) for i in range(7)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in quantile.exact_quantiles(df, "v", ["g"], (0.5, 0.9, 0.99)).collect()}
    pdf = pd.DataFrame(data, columns=["g", "v"])
    for (g, p), q in got.items():
        assert abs(q - pdf[pdf.g == g].v.quantile(p)) < 1e-9


def test_quantiles_of_large_groups_and_outliers(spark):
    """More rows than one by one: brackets from the sketch; one value 1e9 times the bulk."""
    df = spark.range(60_000).selectExpr("id % 2 as g", "pow(id * 7919 % 60013, 2) as v").unionAll(
        spark.createDataFrame([(0, 1e18), (1, -1e18)], "g long, v double"))
    probs = (0.0, 0.25, 0.5, 0.999, 1.0)
    got = {(r.g, r.prob): r.quantile for r in quantile.exact_quantiles(df, "v", ["g"], probs, accuracy=1000).collect()}
    pdf = df.toPandas()
    assert len(got) == 10
    for (g, p), q in got.items():
        assert q == pytest.approx(pdf[pdf.g == g].v.quantile(p), rel=1e-12)


def test_stratified_split_hot_stratum(spark):
    data = [(i, "hot") for i in range(1, 3001)] + [(i, f"s{i % 7}") for i in range(3001, 4001)]
    df = spark.createDataFrame(data, "id long, s string")
    out = sample.stratified_split(df, "id", ["s"], 0.25, seed=4)
    assert out.count() == len(data)                                  # whole: every row kept
    cnt = {r.s: r["count"] for r in out.where(F.col("split") == "test").groupBy("s").count().collect()}
    assert cnt["hot"] == 750


def test_split_orders_no_stratum_whole(spark, monkeypatch):
    """A boundary is looked for in one range of hash values: no window gets all rows of a stratum."""
    seen, held = [], sample.few_rows
    monkeypatch.setattr(sample, "few_rows", lambda df: seen.append(df) or held(df))
    df = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, null, 'big') as s")
    q = spark.createDataFrame([("big", 4321), (None, 5000)], "s string, quota long")
    got = {r.id for r in sample.rank_select(df, ["s"], "id", q, seed=3).where("selected").collect()}
    h = {r.id: (r.h, r.id) for r in df.select("id", sample.hash_bucket("id", 3).alias("h")).collect()}
    assert got == set(sorted((i for i in h if i % 10), key=h.get)[:4321]) | {i for i in h if i % 10 == 0}
    assert len(seen) == 2 and "_g" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {r._in for r in seen[0].collect()} - {None}  # the range that holds the boundary


def test_prefix_sums_of_many_buckets(spark):
    """Offsets of many buckets, queries outside the points' range included."""
    from casework.operators.quantile import prefix_sums
    rnd = random.Random(9)
    pts = [("K", round(rnd.uniform(0, 100), 3)) for _ in range(400)] + [("K", 50.0)] * 50
    qs = [(i, "K", round(rnd.uniform(-5, 105), 3), bool(i % 2)) for i in range(60)]
    p = spark.createDataFrame(pts, "k string, x double").groupBy("k", "x").count() \
             .withColumn("w", F.col("count").cast("double"))
    q = spark.createDataFrame(qs, "id long, k string, x double, strict boolean")
    got = {r.id: r.w for r in prefix_sums(p, q, ["k"], "x", ["w"], "id", strict="strict",
                                            bucket_width=0.5).collect()}
    for i, k, x, strict in qs:
        want = sum(1 for kk, xx in pts if kk == k and (xx < x if strict else xx <= x))
        assert got[i] == want, (i, x, strict)
