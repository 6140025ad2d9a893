"""Policies on hand-made score rows (FIXTURES F6/F7)."""

from pyspark.sql import functions as F

from casework.operators import evaluate, policy
from casework.sources.cases import THRESHOLD_SCHEMA


def test_auto_approve_boundary(spark):
    df = spark.createDataFrame([("Utvidet bruk", 0.8), ("Varig tillatelse", 0.7999), ("Avslag", 0.99), (None, 0.9)],
                               "p string, c double")
    got = [r[0] for r in df.select(policy.auto_approve("p", "c")).collect()]
    assert got == ["AUTO_APPROVE", "MANUAL_REVIEW", "MANUAL_REVIEW", "MANUAL_REVIEW"]


def test_gate_normalisation(spark):
    tab = chr(9)
    df = spark.createDataFrame([(" Mindre  streng ",), ("Lite" + tab + "streng",), ("Streng",), (None,)], "c string")
    assert [r[0] for r in df.select(policy.gate_ok("c")).collect()] == [True, True, False, False]


def test_two_stage_decide_null_threshold_and_gate(spark):
    thr = spark.createDataFrame([(1, "Avslag", 0.9, 0.99), (2, "Utvidet bruk", None, 0.99),
                                 (2, "Varig tillatelse", 0.6, 0.99)], THRESHOLD_SCHEMA)
    rows = [(1, "Avslag", 0.95, "Varig tillatelse", 0.9, True),       # stage 1 fires
            (2, "Avslag", 0.85, "Varig tillatelse", 0.9, True),       # below t1, not a permit -> manual
            (3, "Tillatelse", 0.1, "Utvidet bruk", 0.99, True),       # NULL t2 never fires
            (4, "Tillatelse", 0.1, "Varig tillatelse", 0.6, True),    # t2 reached exactly
            (5, "Tillatelse", 0.1, "Varig tillatelse", 0.7, False)]   # blocked by the gate
    df = spark.createDataFrame(rows, "id int, stage1_pred string, p_reject double, stage2_class string, "
                                     "stage2_p double, ok boolean")
    out = {r.id: (r.auto_decision, r.decision_conf) for r in
           policy.two_stage_decide(df, thr, gate=F.col("ok")).collect()}
    assert out == {1: ("Avslag", 0.95), 2: ("manual_review", None), 3: ("manual_review", None),
                   4: ("Varig tillatelse", 0.6), 5: ("manual_review", None)}
    m = policy.policy_metrics(policy.two_stage_decide(df, thr, gate=F.col("ok"))
                              .withColumn("truth", F.lit("Avslag")), "auto_decision", "truth", gate="ok").first()
    assert m.auto_n == 2 and m.blocked == 1 and m.auto_accuracy == 0.5 and m.coverage == 0.4


def test_argmax_first_on_tie(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    cls, p = evaluate.argmax_class("p", ["a", "b", "c"])
    assert [(r[0], r[1]) for r in df.select(cls, p).collect()] == [("a", 0.4), ("c", 0.7)]


def test_confusion_zero_filled_and_valid_only(spark):
    df = spark.createDataFrame([("Godkjent", "Godkjent"), ("Avslag", "Feil"), ("Avslag", "Avslag")],
                               "t string, p string")
    got = {(r.truth, r.pred): r.n for r in evaluate.confusion(df, "t", "p", ["Godkjent", "Avslag"]).collect()}
    assert got == {("Godkjent", "Godkjent"): 1, ("Godkjent", "Avslag"): 0, ("Avslag", "Godkjent"): 0,
                   ("Avslag", "Avslag"): 1}
