"""C4 along a road (brute force), binned densities and the sketch gate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import enrich, profile


def _brute(extents, positions):
    out = {}
    for road, m in positions:
        hit = [o for r, a, b, o in extents if None not in (road, m, r, a, b) and r == road and a <= m <= b]
        if hit:
            out[(road, m)] = min(hit)
    return out


def _first(spark, extents, positions):
    e = spark.createDataFrame(extents, "_road string, _from double, _to double, _best long")
    p = spark.createDataFrame(positions, "_road string, _m double")
    return {(r._road, r._m): r._best for r in enrich.first_extent(e, p).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_extent_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    extents = []
    for i in range(900):
        a = float(rng.integers(0, 4000)) / (1 if rng.random() < 0.7 else 7)
        size = [0.0, 3.0, 250.0, 4000.0][rng.integers(0, 4)]
        extents.append((["A", "B"][int(rng.random() < 0.1)], a, a + size, int(rng.integers(0, 5000))))
    extents += extents[:50] + [(None, 1.0, 9.0, 1), ("A", None, 9.0, 2), ("A", 9.0, 1.0, 3), ("A", 5.0, None, 4)]
    positions = [("A", float(x)) for x in rng.integers(-10, 8100, 700)] + [("B", float(x) / 7) for x in rng.integers(0, 20000, 300)]
    positions += [(r, a) for r, a, _, _ in extents[:200]] + [(r, b) for r, _, b, _ in extents[:200]]  # ends count
    positions += [("C", 1.0), (None, 1.0), ("A", None)]
    assert _first(spark, extents, positions) == _brute(extents, set(positions))


def test_a_long_extent_costs_what_its_ends_cost(spark):
    """A thousand kilometres over a few short objects: the plan holds no row for
    each stretch of the road."""
    extents = [("A", 0.0, 1e6, 7), ("A", 10.0, 20.0, 3), ("A", 5e5, 5e5, 9)]
    at = [("A", 0.0), ("A", 15.0), ("A", 20.5), ("A", 5e5), ("A", 1e6), ("A", 1e6 + 1)]
    assert _first(spark, extents, at) == {("A", 0.0): 7, ("A", 15.0): 3, ("A", 20.5): 7, ("A", 5e5): 7, ("A", 1e6): 7}
    e = spark.createDataFrame(extents, "_road string, _from double, _to double, _best long")
    ends = e.select("_road", F.explode(F.array("_from", "_to")).alias("_pos")).distinct()
    assert sorted(r._unit for r in enrich._places(ends, ends).collect()) == [1, 3, 5, 7, 9]


def test_first_extent_without_rows(spark):
    assert _first(spark, [], [("A", 1.0)]) == {}
    assert _first(spark, [("A", 0.0, 1.0, 1)], []) == {}


def test_lookup_prefers_the_first_object_and_splits_ties_by_value(spark):
    obj = spark.createDataFrame(
        [(1, 1, 5, [("p", "x")], [("A", 0.0, 10.0)]), (1, 2, 4, [("p", "late")], [("A", 5.0, 50.0), ("B", 0.0, 1.0)]),
         (1, 3, 4, [("p", "early")], [("A", 6.0, 7.0)]), (1, 4, None, [("p", "none")], [("A", 0.0, 99.0)]),
         (2, 5, 1, [("p", "other")], [("A", 0.0, 99.0)])],
        "object_type int, object_id long, ord long, properties array<struct<name:string,value:string>>, "
        "references array<struct<road:string,meter:double,meter_to:double>>")
    cases = spark.createDataFrame([(1, "A m3"), (2, "A m5"), (3, "A m6.5"), (4, "A m60"), (5, "B"), (6, None), (7, "A")],
                                  "case_id long, road_ref string")
    got = {r.case_id: r.v for r in enrich.lookup_by_reference(cases, obj, 1, "p", "v", default="-").collect()}
    assert got == {1: "x", 2: "late", 3: "early", 4: "-", 5: "late", 6: "-", 7: "early"}


def test_kde_of_many_values_equals_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(5, 2, 1500), "b": np.concatenate([rng.exponential(1.0, 800), [400.0]])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("one", 1.0)],
                               "g string, v double")
    out = profile.kde_grid(df, "v", ["g"], gridsize=60, decimals=15).collect()
    assert {r.g for r in out} == {"a", "b"} and len(out) == 120
    for g, vs in values.items():
        n, h = len(vs), len(vs) ** -0.2 * np.std(vs, ddof=1)
        lo, step = vs.min() - 3 * h, (vs.max() - vs.min() + 6 * h) / 59
        for r in (r for r in out if r.g == g):
            want = np.exp(-0.5 * ((lo + r.grid_idx * step - vs) / h) ** 2).sum() / (n * h * math.sqrt(2 * math.pi))
            assert abs(r.density - want) < 1e-14 / h + 1e-15


def test_kde_plan_has_no_row_for_each_value(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") * F.lit(0.37)).alias("v"))
    plan = profile.kde_grid(df, "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    # what meets the grid is grouped by the middle of its bin, not by the value
    assert "Aggregate [g" in plan and "_v#" not in plan[:plan.index("Generate explode")]


@pytest.mark.parametrize("limit", [3, 50, 5000])
def test_encode_gate_equals_the_exact_gate(spark, limit):
    df = spark.range(20_000).select(
        (F.col("id") % 3).cast("string").alias("three"), (F.col("id") % 4).cast("string").alias("four"),
        (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more"),
        (F.col("id") % limit).alias("at"), (F.col("id") % (limit + 1)).alias("over"), F.col("id").cast("string").alias("key"),
        F.when(F.col("id") % 2 == 0, "").alias("blank"), F.lit(None).cast("string").alias("none"))
    want = {(r.column_name, r.encode) for r in profile.cardinality_gate(df, df.columns, limit).collect()}
    got = profile.encode_gate(df, df.columns, limit)
    assert {(r.column_name, r.encode) for r in got.collect()} == want
    with pytest.raises(ValueError):
        profile.encode_gate(df, ["three"], 1 << 25)
