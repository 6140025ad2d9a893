"""Tables of a few keys never send the rows of a key to one task."""

import pytest
from pyspark.sql import functions as F

from casework.operators import forests, models, quantile, sample


@pytest.fixture
def unhinted(spark):
    """Only what is hinted is broadcast, as where the sizes are not known."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


CASES = {
    "quantiles": lambda df: quantile.exact_quantiles(df, "v", ["g"]),
    "class_weights": lambda df: models.class_weights(df, "g"),
    "bootstrap": lambda df: forests.bootstrap_weights(df, "id", "g", 2),
    "split": lambda df: sample.stratified_split(df, "id", ["g"]),
    "oversample": lambda df: sample.oversample(df, "id", "g"),
}


@pytest.mark.parametrize("name", CASES)
def test_rows_of_a_key_stay_where_they_are(unhinted, name):
    df = unhinted.range(2000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), F.sqrt("id").alias("v"))
    out = CASES[name](df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and "broadcast" in joins[0], plan   # the join that holds the rows


def test_replies_are_parsed_before_they_meet_cases(spark):
    from casework.operators import replies
    prompts = spark.createDataFrame([(i, "same") for i in range(9)] + [(9, None), (10, "other")], "case_id long, prompt string")
    inbox = prompts.where("case_id = 0").select(replies.prompt_key("prompt").alias("prompt_key"), F.current_timestamp().alias("received_at"),
                                                F.lit('{"approve": true}').alias("reply"), F.lit(None).cast("string").alias("error"))
    out = replies.settle(prompts, inbox)
    assert {(r.status, r.decision, r.valid) for r in out.collect()} == {("answered", "Godkjent", True), ("open", None, False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Join ")]
    assert "from_json" not in top and "json_tuple" not in top and "approve" not in top, top


def test_one_parse_of_a_number(spark):
    """A number's text is read once for a count: before, seven times."""
    from pyspark.sql import types as T
    from casework.sources import cases
    df = spark.createDataFrame([(" 12,0 ",), ("12.5",), ("nan",), ("7",), (None,), ("1e30",)], "accidents string")
    out = cases.conform(df, T.StructType([T.StructField("accidents", T.IntegerType())]))
    assert [r.accidents for r in out.collect()] == [12, None, None, 7, None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
