"""Physical-plan checks: no cartesian or nested-loop joins anywhere, filters
reach the Parquet scan, and scans read only the needed columns."""

import pytest

SF = "/root/testdata/sf0.001"
MODEL = {"reject_model", "reject_report", "importances", "adasyn_rows", "weighted_forest",
         "multiclass_forest", "difficulty_model", "contributions", "batch", "two_stage_job", "stream"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _names():
    import __spark_entry__ as E
    return sorted(n for n in E.queries() if n not in MODEL)


@pytest.mark.parametrize("name", _names())
def test_no_pairwise_joins(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_facet_filter_pushdown(spark):
    import __spark_entry__ as E
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(E.queries()["facet_filter"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice,50000.0)" in plan
    assert "In(c_mktsegment, [BUILDING,MACHINERY])" in plan


def test_column_pruning(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["count_within"](spark, SF))
    assert "l_shipdate" not in plan and "l_comment" not in plan
