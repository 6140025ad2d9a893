"""Reply intake, the run registry and the scoring stream's sink."""

import datetime
import math
import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casework.functions.clean import APPROVE, ERROR, REJECT
from casework.operators import replies
from casework.plans import jobs
from casework.sources import registry
from casework.streaming import score_stream as st

SF = "/root/testdata/sf0.001"


def _at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def _answer(spark, folder, *rows):
    spark.createDataFrame(list(rows), replies.INBOX) \
        .write.mode("append").parquet(f"{folder}/inbox")


def _keys(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "prompt string").select("prompt", replies.prompt_key("prompt").alias("k")).collect()
    return {r.prompt: r.k for r in rows}


def test_rounds_of_prompts_and_replies(spark, tmp_path):
    folder = str(tmp_path)
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d"), (6, None)], "case_id long, prompt string")
    k = _keys(spark, "abcd")
    state = {r.case_id: r.status for r in replies.run(prompts, folder).collect()}
    assert set(state.values()) == {"open"}
    asked = spark.read.parquet(f"{folder}/outbox")
    assert sorted(r.prompt for r in asked.collect()) == ["a", "b", "c", "d"]
    # a twice (the first counts), b after an error, c only an error, d late
    _answer(spark, folder, (k["a"], _at(2), '{"approve": false}', None), (k["a"], _at(1), '{"approve": true, "reason": "ok"}', None),
            (k["a"], _at(1), '{"approve": true, "reason": "ok"}', None), (k["b"], _at(1), None, "timeout"),
            (k["b"], _at(3), "not json", None), (k["c"], _at(1), None, "timeout"), (k["d"], _at(9), '{"approve": 1}', None),
            ("nobody", _at(1), "{}", None))
    state = {r.case_id: r for r in replies.run(prompts, folder, as_of=_at(5)).collect()}
    assert {i: (r.status, r.decision, r.valid) for i, r in state.items()} == {
        1: ("answered", APPROVE, True), 2: ("answered", APPROVE, True), 3: ("answered", ERROR, False),
        4: ("failed", ERROR, False), 5: ("open", None, False), 6: ("open", None, False)}
    assert state[1].reason == "ok" and state[4].reason == "timeout"
    assert spark.read.parquet(f"{folder}/outbox").count() == 4  # nothing is asked twice
    results = lambda: sorted(r.case_id for r in spark.read.parquet(f"{folder}/results").collect())
    assert results() == [1, 2, 3]
    _answer(spark, folder, (k["c"], _at(2), '{"approve": "x"}', None), (k["a"], _at(0), '{"approve": false}', None))
    more = prompts.unionByName(spark.createDataFrame([(7, "a"), (8, "e")], prompts.schema))
    for _ in range(2):
        replies.run(more, folder)
        assert results() == [1, 2, 3, 4, 5, 7]
        assert spark.read.parquet(f"{folder}/outbox").count() == 5
    kept = {r.case_id: r.decision for r in spark.read.parquet(f"{folder}/results").collect()}
    assert kept == {1: APPROVE, 2: APPROVE, 3: ERROR, 4: APPROVE, 5: APPROVE, 7: REJECT}  # a stored decision stays


def test_batch_settles_every_case(spark):
    b = jobs.batch(spark, SF)
    rows = b.select("case_id", "status", "decision", "valid").collect()
    assert len({r.case_id for r in rows}) == len(rows) == jobs.model_cases(spark, SF).count()
    assert {"answered", "open"} <= {r.status for r in rows} <= {"answered", "failed", "open"}
    assert all((r.decision is None) == (r.status == "open") and r.valid == (r.decision in (APPROVE, REJECT)) for r in rows)


def _model(spark, c):
    df = spark.createDataFrame([(float(c),)], ["x"])
    return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol=f"v{c}")]).fit(df)


def test_a_run_is_read_only_when_complete(spark, tmp_path):
    root = str(tmp_path)
    assert registry.latest(spark, root, "k") is None
    one = registry.save(spark, root, "k", {"m": _model(spark, 1)}, {"t": spark.range(3)}, {"a": 1.5, "classes": ["x"]})
    with pytest.raises(ZeroDivisionError):  # breaks off between the model and the manifest
        registry.save(spark, root, "k", {"m": _model(spark, 2)}, {"t": spark.range(4), "u": _broken()}, {})
    got = registry.latest(spark, root, "k")
    assert (got.run_id, got.version, got.record) == (one.run_id, 1, {"a": 1.5, "classes": ["x"]})
    assert got.table("t").count() == 3 and got.model("m").stages[0].getOutputCol() == "v1"
    two = registry.save(spark, root, "k", {}, {}, {})
    registry.save(spark, root, "other", {}, {}, {})
    assert registry.latest(spark, root, "k").run_id == two.run_id and two.version == 2
    assert len(os.listdir(tmp_path / "runs")) == 2  # the half-written one is there, unread


def _broken():
    class Broken:
        @property
        def write(self):
            return 1 / 0
    return Broken()


def _cases(spark, path, n, start=0):
    spark.range(start, start + n).selectExpr("id as case_id", "id * 2.5 as x").coalesce(1).write.mode("append").parquet(path)


def test_a_killed_stream_goes_on_without_doubles(spark, tmp_path):
    arrivals, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for i in range(4):
        _cases(spark, arrivals, 10, 10 * i)
    schema = spark.read.parquet(arrivals).schema
    score = lambda df: df.withColumn("p", F.col("x") / 10)
    sink, calls = st.write_once(out, score), []

    def dies_after_data(batch, batch_id):
        calls.append(batch_id)
        if batch_id == 2 and calls.count(2) == 1:   # rows written, not committed
            score(batch).write.mode("overwrite").parquet(f"{out}/data/batch_id=2")
            raise RuntimeError("killed")
        sink(batch, batch_id)
        if batch_id == 1 and calls.count(1) == 1:   # committed, the stream does not know
            raise RuntimeError("killed")

    go = lambda: st.score_stream(spark, arrivals, schema, out, ckpt, score, files_per_batch=1, sink=dies_after_data)
    for seen in (20, 20):
        with pytest.raises(Exception, match="killed"):
            go()
        assert st.read_scored(spark, out).count() == seen
    assert go().count() == 40
    _cases(spark, arrivals, 5, 40)
    rows = go().collect()
    assert sorted(r.case_id for r in rows) == list(range(45)) and all(math.isclose(r.p, r.x / 10) for r in rows)
    assert calls.count(1) == 2 and calls.count(2) == 2
    assert sorted(map(tuple, go().collect())) == sorted(map(tuple, rows))


def test_stream_equals_batch_in_all_columns(spark, tmp_path):
    run = jobs.fit_case_models(spark, SF, str(tmp_path / "registry"))
    m = jobs.stored_models(registry.latest(spark, str(tmp_path / "registry"), "case_models"))
    assert run.models == ["hard", "hard_reject", "reject", "stage1", "stage2"]
    t = jobs.Tables(spark, SF)
    got = st.score_stream(spark, SF, t.orders.schema, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                          lambda b: jobs.score_cases(jobs.cases_from(b, t.customer), m), file_filter="orders.parquet").drop("batch_id")
    want = jobs.score_cases(jobs.model_cases(spark, SF), m)
    assert got.columns == want.columns and {"p_difficult", "route", "auto_decision", "decision_conf"} <= set(got.columns)
    key = lambda r: r[0]
    a, b = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)
    assert len(a) == len(b) == t.orders.count()
    assert all(x == y or (isinstance(x, float) and math.isclose(x, y)) for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))
