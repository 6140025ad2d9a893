"""Bags, bootstraps, merged forests and their contributions."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casework.operators import forests, models, sample
from casework.plans import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cases(spark):
    return jobs.model_cases(spark, SF).cache()


def test_merged_probability_is_the_mean_of_the_parts(spark, cases):
    drawn = sample.balanced_bags(cases, "case_id", "y", 1.0, bags=3, ratio=1.0, seed=2)
    kept = []
    merge, forests.merge_forests = forests.merge_forests, lambda parts, s: kept.extend(parts) or merge(parts, s)
    try:
        model = forests.fit_bags(drawn, jobs.INPUTS, "y", 3, trees_per_bag=2, depth=4, leaf=True)
    finally:
        forests.merge_forests = merge
    rows = model.stages[0].transform(cases.limit(300))
    parts = [np.array([r[0] for r in p.transform(rows).orderBy("case_id").select(vector_to_array("probability")).collect()]) for p in kept]
    whole = np.array([r[0] for r in model.transform(cases.limit(300)).orderBy("case_id").select(vector_to_array("probability")).collect()])
    assert len(kept) == 3 and model.stages[-1].getNumTrees == 6
    assert np.allclose(whole, np.mean(parts, axis=0), atol=1e-12)
    # its contributions add up too, without an exchange above the scan
    con = models.forest_contributions(model, cases, "case_id", jobs.INPUTS)
    total = {r.case_id: r.s for r in con.groupBy("case_id").agg(F.sum("contribution").alias("s")).collect()}
    p = {r.case_id: r.p for r in model.transform(cases).select("case_id", vector_to_array("probability")[1].alias("p")).collect()}
    assert total.keys() == p.keys() and all(abs(total[k] - p[k]) < 1e-9 for k in p)
    plan = con._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.split("MapInArrow")[0].count("Exchange") == 0 and "Aggregate" not in plan.split("MapInArrow")[0]


def test_both_forms_of_contributions_agree(spark, cases):
    model = models.forest_pipeline(jobs.INPUTS, "y", 5, 4, leaf=True).fit(cases)
    few = models.forest_contributions(model, cases, "case_id", jobs.INPUTS)
    limit, forests.LEAF_TABLE_BYTES = forests.LEAF_TABLE_BYTES, 0
    try:
        joined = models.forest_contributions(model, cases, "case_id", jobs.INPUTS)
    finally:
        forests.LEAF_TABLE_BYTES = limit
    a, b = ({(r.case_id, r.feature): r.contribution for r in df.collect()} for df in (few, joined))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_bootstrap_is_poisson_and_weights_balance_each_bag(spark, cases):
    rows = forests.bootstrap_weights(cases, "case_id", "y", 5, seed=1).select("bag", "y", "draws", "weight").collect()
    n = cases.count()
    for bag in range(1, 6):
        own = [r for r in rows if r.bag == bag]
        drawn = sum(r.draws for r in own)
        assert abs(drawn / n - 1) < 0.1 and abs(len(own) / n - (1 - math.exp(-1))) < 0.05
        for y in (0.0, 1.0):  # both classes weigh the same
            assert math.isclose(sum(r.weight for r in own if r.y == y), drawn / 2, rel_tol=1e-9)


def test_reject_model_knows_classes_and_derived_numbers(spark, cases):
    fit = jobs._reject_fit(spark, SF, trees=(10, 10))
    assert fit["classes"]["purpose"] and set(fit["derived"]) == {"long_day", "hill", "bend"}
    for r in fit["bags"].groupBy("bag").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).collect():
        assert r.a == r.b > 0
    odd = cases.withColumn("purpose", F.lit("never seen")).withColumn("price_k", F.lit(None).cast("double"))
    assert models.serve_reject(fit, odd, "case_id").where("p_reject between 0 and 1").count() == cases.count()
