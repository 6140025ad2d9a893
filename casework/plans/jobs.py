"""Model-backed queries and composed jobs.

Stand-in case table: orders joined with customers; the reject label is
derived from two real inputs plus a little hash noise (labels in the test
tables are independent of the numerics, so a real signal has to be built).
These queries are checked rows-only plus invariants in tests/.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions import clean, derive, text
from casework.operators import evaluate, forests, models, policy, replies, sample, similar
from casework.session import materialize, scratch_dir
from casework.sources import registry
from casework.sources.cases import THRESHOLD_SCHEMA, export_ordered
from casework.sources.tables import Tables
from casework.streaming.score_stream import score_stream

INPUTS = ["price_k", "acctbal_k", "days_h", "nation"]


def model_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return cases_from(t.orders, t.customer)


def held_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table, joined once: splits and fits read it many times."""
    return materialize(model_cases(spark, sf_dir))


def cases_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Case rows from orders (batch or stream) and the customer table."""
    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    noise = sample.hash_bucket("o_orderkey", 17) < int(sample.HASH_MOD * 0.03)   # ~3 % flipped labels
    sig = (F.col("o_totalprice") > 250000) & (F.col("c_acctbal") < 2000)
    y = (sig != noise).cast("double")
    return o.select(F.col("o_orderkey").alias("case_id"),
                    (F.col("o_totalprice") / 1000).alias("price_k"),
                    (F.col("c_acctbal") / 1000).alias("acctbal_k"),
                    (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / 100.0)
                    .alias("days_h"),
                    F.col("c_nationkey").cast("double").alias("nation"),
                    F.col("o_orderpriority").alias("policy_class"), F.col("c_mktsegment").alias("purpose"),
                    y.alias("y"))


def _reject_fit(spark, sf_dir, trees=(20, 40)):
    """The two-pass forest; the price and nation stand for traffic and its long
    vehicles, the days for a gradient, the balance for a bend's radius."""
    derived = {"long_day": derive.long_vehicles("price_k", "nation"), "hill": derive.gradient_indicator("days_h"),
               "bend": derive.curve_sigmoid(F.col("acctbal_k") * 1000)}
    return models.fit_reject_model(model_cases(spark, sf_dir), "case_id", INPUTS, "y", screen_trees=trees[0],
                                   final_trees=trees[1], depth=6, top=10, class_cols=["purpose"], derived=derived)


def reject_model(spark, sf_dir):
    """H1 + H5: two-pass balanced forest, hold-out scored with percent and band."""
    fit = _reject_fit(spark, sf_dir)
    scored = models.score_reject(fit["model"], fit["test"])
    return scored.select("case_id", "y", "p_reject", "percent", "band",
                         F.col("prediction").alias("pred"))


def reject_report(spark, sf_dir):
    """H1 + D20 + D13: hold-out class report of the reject model."""
    sc = reject_model(spark, sf_dir).withColumn("truth", F.col("y").cast("int").cast("string")) \
                                     .withColumn("pr", F.col("pred").cast("int").cast("string"))
    return evaluate.class_report(sc, "truth", "pr")


def importances(spark, sf_dir):
    """E3 + H8: top-10 interaction features of the screening pass."""
    return _reject_fit(spark, sf_dir)["importances"]


def adasyn_rows(spark, sf_dir):
    """Synthetic minority rows (ratio 0.5, k = 5)."""
    df = model_cases(spark, sf_dir)
    tr = sample.hash_split(df, "case_id", (0.6, 0.4), seed=43).where(F.col("split") == "train")
    return models.adasyn(tr, "case_id", INPUTS, "y", 1.0, 5, 0.5, 42)


def weighted_forest(spark, sf_dir):
    """H2: forest with class weights of each bootstrap, hold-out predictions."""
    sp = sample.hash_split(held_cases(spark, sf_dir), "case_id", (0.8, 0.2), seed=5)
    drawn = forests.bootstrap_weights(sp.where(F.col("split") == "train"), "case_id", "y", 10, seed=5)
    m = forests.fit_bags(drawn, INPUTS, "y", 10, depth=6, weight="weight")
    return models.score_reject(m, sp.where(F.col("split") == "test")).select("case_id", "y", "p_reject", "band")


def bootstrap_weights(spark, sf_dir):
    """H2: the draws and weights of the rows in four bootstraps."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority")
    return forests.bootstrap_weights(o, "o_orderkey", "o_orderpriority", 4, seed=3).select(
        "bag", "o_orderkey", "draws", F.round("weight", 9).alias("weight"))


def bag_ratios(spark, sf_dir):
    """H1 + G6: rows of either class in each bag that the trees of a balanced
    forest see (half a majority row for each minority row), on the orders' labels."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("y"))
    return sample.balanced_bags(o, "o_orderkey", "y", 1.0, bags=6, ratio=0.5, seed=43).groupBy("bag").agg(
        F.count_if(F.col("y") == 1).alias("minority"), F.count_if(F.col("y") == 0).alias("majority"), F.sum("o_orderkey").alias("key_sum"))


def multiclass_forest(spark, sf_dir):
    """H3 + E5: plain multi-class forest on the priority class; arg-max class."""
    from casework.operators import features
    df = model_cases(spark, sf_dir)
    classes = features.vocabulary(df, "policy_class")
    enc = features.label_encode(df, ["policy_class"], vocab={"policy_class": classes})
    enc = enc.withColumn("cls", F.col("policy_class_code").cast("double"))
    sp = sample.hash_split(enc, "case_id", (0.8, 0.2), seed=6)
    m = models.forest_pipeline(INPUTS, "cls", 20, 5).fit(sp.where(F.col("split") == "train"))
    out = m.transform(sp.where(F.col("split") == "test"))
    cls, conf = evaluate.argmax_class(models.vector_to_array("probability"), classes)
    out = out.select("case_id", "policy_class", cls.alias("pred_class"), conf.alias("confidence"))
    return out.withColumn("decision", policy.auto_approve("pred_class", "confidence",
                                                          favourable=("1-URGENT", "2-HIGH")))


DIFFICULTY_INPUTS = [*INPUTS, "price_per_nation", "log_price", "p_reject", "reject_bit"]


def _difficulty_inputs(cases, reject):
    """H4/H6 inputs: the raw ones, a ratio, a log, and the reject model's probability and bit."""
    scored = models.score_reject(reject, cases)
    return (scored.withColumn("price_per_nation", F.col("price_k") / (F.col("nation") + 1))
            .withColumn("log_price", F.log1p(F.greatest("price_k", F.lit(0.0))))
            .withColumn("reject_bit", F.col("prediction")).drop("prediction", "percent", "band"))


def _difficulty(spark, sf_dir, rounds=30, cases=None):
    """Model, scored test part and threshold; the threshold comes from a
    validation part that neither the fit nor the report sees."""
    cases = held_cases(spark, sf_dir) if cases is None else cases
    df = cases.withColumn("difficult", (F.col("days_h") > 12).cast("double"))
    # each part is read many times: split once
    sp = materialize(sample.stratified_split(df, "case_id", ["difficult"], 0.4, seed=42))
    inner = materialize(sample.stratified_split(sp.where(F.col("split") == "train").drop("split"), "case_id", ["difficult"], 0.25,
                                                seed=43, names=("fit", "val")))
    fit = inner.where(F.col("split") == "fit").drop("split")
    reject = models.forest_pipeline(INPUTS, "y", 20, 5).fit(fit)
    # the class ratio is taken before the classes are made equal
    counts = fit.agg(F.count_if(F.col("difficult") == 0).alias("easy"), F.count_if(F.col("difficult") == 1).alias("hard"))
    ratio = counts.select(F.col("easy") / F.greatest("hard", F.lit(1))).scalar()
    over = sample.oversample(_difficulty_inputs(fit, reject), "case_id", "difficult", seed=1).drop("copy")
    over = materialize(over.withColumn("weight", F.when(F.col("difficult") == 1, ratio).otherwise(F.lit(1.0))))
    m = models.gbt_pipeline(DIFFICULTY_INPUTS, "difficult", rounds=rounds, weight="weight").fit(over)
    val = _difficulty_inputs(inner.where(F.col("split") == "val").drop("split"), reject)
    val = models.score_difficulty(m, val, DIFFICULTY_INPUTS, 0.5)
    thr = evaluate.grid_threshold(val, "p_difficult", "difficult").first()["threshold"]
    test = _difficulty_inputs(sp.where(F.col("split") == "test").drop("split"), reject)
    return m, test, float(thr), reject


def difficulty_model(spark, sf_dir):
    """H4 + H6 + E8: boosted difficulty model, grid threshold, scored cases."""
    m, test, thr, _ = _difficulty(spark, sf_dir)
    return models.score_difficulty(m, test, DIFFICULTY_INPUTS, thr).select(
        "case_id", "difficult", "p_difficult", "difficulty_pred")


def served_rejects(spark, sf_dir):
    """H1 + H5: every raw case scored by the reject model."""
    return models.serve_reject(_reject_fit(spark, sf_dir), model_cases(spark, sf_dir), "case_id")


def contributions(spark, sf_dir):
    """H7: per case and feature path contributions (bias + sum = probability)."""
    df = model_cases(spark, sf_dir)
    m = models.forest_pipeline(INPUTS, "y", 20, 5, leaf=True).fit(df)
    return models.forest_contributions(m, df, "case_id", INPUTS)


def batch(spark, sf_dir):
    """Score -> explain -> retrieve -> prompt -> outbox, inbox -> parse ->
    difficulty -> one case table.  The first round asks all prompts; replies
    come to the inbox (here from the conversations); the second round asks only
    what is open and stores what is settled.  The guideline a prompt points at
    is the longest document."""
    df = held_cases(spark, sf_dir)
    guide = Tables(spark, sf_dir).documents.select(F.max_by("doc_id", F.struct("n_chars", "doc_id"))).scalar()
    m = models.forest_pipeline(INPUTS, "y", 20, 5, leaf=True).fit(df)
    sc = models.score_reject(m, df)
    con = models.forest_contributions(m, df, "case_id", INPUTS)
    vals = df.select("case_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"))
                                                     for f in INPUTS])).alias("v")).select("case_id", "v.*")
    fac = con.where(F.col("feature") != "bias").join(vals, ["case_id", "feature"]).groupBy("case_id").agg(
        F.collect_list(F.struct(F.col("feature").alias("name"), "value", "contribution")).alias("factors"))
    expl = sc.select("case_id", "p_reject").join(fac, "case_id").select(
        "case_id", text.explanation_text("p_reject", "factors").alias("explanation"))
    cases = df.withColumn("label", F.when(F.col("y") == 1, F.lit(clean.REJECT)).otherwise(F.lit(clean.APPROVE)))
    from casework.operators import features
    z = features.zscore(cases, INPUTS, suffix="")
    sim = similar.similar_cases(z, "case_id", "label", clean.APPROVE, "policy_class", "purpose", INPUTS, k=1)
    ct = cases.select("case_id", text.format_case(cases.select(*INPUTS, "policy_class", "purpose"))
                      .alias("case_text"))
    ex = sim.join(ct.withColumnRenamed("case_id", "example_id").withColumnRenamed("case_text", "ex_text"),
                  "example_id").groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", text.example_block("ex_text", F.lit(True)).alias("b"))))
        .alias("_e")).select("case_id", F.transform("_e", lambda x: x["b"]).alias("examples"))
    pr = ct.withColumn("guideline_id", guide).join(expl, "case_id", "left").join(ex, "case_id", "left").select(
        "case_id", text.build_prompt("explanation", "case_text",
                                     F.coalesce("examples", F.array().cast("array<string>")),
                                     "guideline_id", "reject_examples").alias("prompt"))
    pr = materialize(pr)
    folder = f"{scratch_dir(spark)}/batch-{uuid.uuid4().hex}"
    replies.run(pr, folder)
    conversation_replies(pr, Tables(spark, sf_dir).conversations).write.mode("append").parquet(f"{folder}/inbox")
    settled = replies.run(pr, folder)
    out = (sc.select("case_id", "y", "p_reject", "percent", "band").join(pr, "case_id")
           .join(settled.select("case_id", "status", "decision", "reason", "valid"), "case_id"))
    hard, _, thr, reject = _difficulty(spark, sf_dir, rounds=10, cases=df)
    level = models.score_difficulty(hard, _difficulty_inputs(df, reject), DIFFICULTY_INPUTS, thr)
    return out.join(level.select("case_id", "p_difficult", "difficulty_pred"), "case_id")


def conversation_replies(prompts: DataFrame, conversations: DataFrame) -> DataFrame:
    """Stand-in inbox: what the assistant says in a conversation answers the
    prompt of the case whose number, in turn, is the conversation's.  Some
    replies are JSON, some plain text, some transport errors; a prompt may have
    several replies or none."""
    n = conversations.select(F.greatest(F.max("conv_id") + 1, F.lit(1))).scalar()
    keyed = prompts.select(F.pmod("case_id", n).alias("conv_id"), replies.prompt_key("prompt").alias("prompt_key"))
    said = conversations.where("role = 'assistant' and conv_id % 11 != 0")
    body = F.to_json(F.struct((F.length("text") % 2 == 0).alias("approve"), F.substring("text", 1, 40).alias("reason")))
    failed = (F.col("conv_id") % 5 == 0) & (F.col("turn") == 1)
    reply = F.when(~failed, F.when(F.col("conv_id") % 7 == 0, F.col("text")).otherwise(body))
    return said.join(keyed, "conv_id").select(
        "prompt_key", F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("turn")).alias("received_at"), reply.alias("reply"),
        F.when(failed, F.lit("timeout")).alias("error"))


def reply_intake(spark, sf_dir):
    """H14 intake: prompts of all customers (equal ones are asked once),
    replies from the conversations, those after four minutes too late."""
    import datetime
    t = Tables(spark, sf_dir)
    prompts = t.customer.select(F.col("c_custkey").alias("case_id"),
                                text.format_case(t.customer.select("c_mktsegment", "c_nationkey")).alias("prompt"))
    inbox = conversation_replies(prompts, t.conversations)
    late = datetime.datetime(2024, 1, 1, 0, 4, tzinfo=datetime.timezone.utc)
    return replies.settle(prompts, inbox, as_of=late).drop("prompt_key")


def reply_outbox(spark, sf_dir):
    """H14 outbox: the prompts that are still to be asked when those of the
    building segment were asked before."""
    t = Tables(spark, sf_dir)
    prompts = t.customer.select("c_mktsegment", text.format_case(t.customer.select("c_mktsegment", "c_nationkey")).alias("prompt"))
    asked = prompts.where("c_mktsegment = 'BUILDING'").select(replies.prompt_key("prompt").alias("prompt_key"))
    return replies.open_prompts(prompts, asked)


def batch_report(spark, sf_dir):
    """H14 + D20: class report of the batch's valid decisions."""
    b = batch(spark, sf_dir).where("valid").withColumn(
        "truth", F.when(F.col("y") == 1, F.lit(clean.REJECT)).otherwise(F.lit(clean.APPROVE)))
    return evaluate.class_report(b, "truth", "decision")


@dataclass(frozen=True)
class TwoStage:
    """The two-stage policy's models, class names and threshold table."""

    stage1: PipelineModel
    stage2: PipelineModel
    classes: list
    thresholds: DataFrame


def fit_two_stage(df: DataFrame) -> tuple[TwoStage, DataFrame]:
    """H15's fit: stage-1 reject forest and its threshold on a validation part,
    stage-2 class forest on the permit pool and per-class thresholds on its own
    validation part, both refitted on all training rows.  Also the test part."""
    from casework.operators import features
    spark = df.sparkSession
    df = df.withColumn("stage1", F.when(F.col("y") == 1, F.lit(clean.REJECT)).otherwise(F.lit(clean.PERMIT)))
    df = df.withColumn("truth", F.when(F.col("y") == 1, F.lit(clean.REJECT)).otherwise(F.col("policy_class")))
    sp = materialize(sample.stratified_split(df, "case_id", ["stage1"], 0.2, seed=1))
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    inner = materialize(sample.stratified_split(train.drop("split"), "case_id", ["stage1"], 0.2, seed=2,
                                                names=("fit", "val")))
    fit1 = models.class_weights(inner.where(F.col("split") == "fit"), "y")
    m1v = models.preprocessed_forest(INPUTS, ["purpose"], "y", 20, 6, weight="weight").fit(fit1)
    v1 = models.score_reject(m1v, inner.where(F.col("split") == "val"))
    v1 = v1.withColumn("pred1", F.col("prediction") == 1).withColumn("hit", F.col("y").cast("int"))
    t1 = evaluate.precision_threshold(v1, "p_reject", "hit", predicted="pred1", target=0.7).first()["threshold"]
    classes = features.vocabulary(df, "policy_class")
    pool = sample.stage2_pool(train.withColumnRenamed("split", "s"), "s", "stage1", train="train")
    pool = features.label_encode(pool, ["policy_class"], vocab={"policy_class": classes}) \
        .withColumn("cls", F.col("policy_class_code").cast("double"))
    pool = materialize(pool)
    inner2 = materialize(sample.stratified_split(pool.drop("s"), "case_id", ["cls"], 0.2, seed=3, names=("fit", "val")))
    m2v = models.preprocessed_forest(INPUTS, ["purpose"], "cls", 20, 5, weight="weight") \
        .fit(models.class_weights(inner2.where(F.col("split") == "fit"), "cls"))
    # thresholds come from the validation parts; the models that decide are refitted on all training rows
    m1 = models.preprocessed_forest(INPUTS, ["purpose"], "y", 20, 6, weight="weight") \
        .fit(models.class_weights(train.drop("split"), "y"))
    m2 = models.preprocessed_forest(INPUTS, ["purpose"], "cls", 20, 5, weight="weight") \
        .fit(models.class_weights(pool, "cls"))
    th = [(1, clean.REJECT, t1, 0.7)]
    pv = m2v.transform(inner2.where(F.col("split") == "val"))
    cls2, p2 = evaluate.argmax_class(models.vector_to_array("probability"), classes)
    pv = pv.withColumn("c2", cls2).withColumn("p2", p2).withColumn("hit2", (F.col("c2") == F.col("policy_class")).cast("int"))
    t2 = evaluate.precision_threshold(pv, "p2", "hit2", by="c2", target=0.7,
                                      classes=spark.createDataFrame([(c,) for c in classes], "class string"))
    th += [(2, r["class"], r["threshold"], 0.7) for r in t2.collect()]  # one row per class
    return TwoStage(m1, m2, classes, spark.createDataFrame(th, THRESHOLD_SCHEMA)), test


def decide_two_stage(cases: DataFrame, m: TwoStage) -> DataFrame:
    """Cases with stage1_pred, stage1_p, stage2_class, stage2_p, auto_decision and decision_conf."""
    s = models.score_reject(m.stage1, cases).withColumnRenamed("p_reject", "stage1_p").withColumn(
        "stage1_pred", F.when(F.col("prediction") == 1, F.lit(clean.REJECT)).otherwise(F.lit(clean.PERMIT)))
    s = m.stage2.transform(s.drop("prediction", "percent", "band", "purpose__idx", "purpose__vec"))
    c2, q2 = evaluate.argmax_class(models.vector_to_array("probability"), m.classes)
    s = s.withColumn("stage2_class", c2).withColumn("stage2_p", q2).drop(
        "features", "rawPrediction", "probability", "prediction", "purpose__idx", "purpose__vec")
    return policy.two_stage_decide(s, m.thresholds, p1="stage1_p")


def two_stage_job(spark, sf_dir, out_dir=None):
    """Split, fit both stages (``fit_two_stage``), policy on the test part.
    Models (A11), thresholds (A9) and the run record (A10) are stored as one
    run below ``out_dir`` (default: the checkpoint folder)."""
    m, test = fit_two_stage(held_cases(spark, sf_dir))
    dec = decide_two_stage(test, m)
    numbers = policy.policy_metrics(dec, "auto_decision", "truth").first().asDict()  # one row
    registry.save(spark, out_dir or f"{scratch_dir(spark)}/registry", "two_stage",
                  {"stage1": m.stage1, "stage2": m.stage2}, {"thresholds": m.thresholds}, numbers | {"classes": m.classes})
    # Id, truth, decision, confidence, stage-1 output, then the features
    out = dec.withColumnRenamed("stage1_p", "p_reject")
    return export_ordered(out.select("case_id", "truth", "auto_decision", "decision_conf", "stage1_pred",
                                     "p_reject", "stage2_class", "stage2_p", *INPUTS),
                          ["case_id", "truth", "auto_decision", "decision_conf", "stage1_pred"])


@dataclass(frozen=True)
class CaseModels:
    """All that scoring a case needs: H5, H6 and H11 models with their thresholds."""

    reject: PipelineModel
    hard: PipelineModel
    hard_reject: PipelineModel
    hard_threshold: float
    two_stage: TwoStage


def fit_case_models(spark, sf_dir, root: str, cases: DataFrame | None = None) -> registry.Run:
    """Fit the models on the case table and store them as a run below ``root``."""
    df = held_cases(spark, sf_dir) if cases is None else cases
    reject = models.forest_pipeline(INPUTS, "y", 20, 5).fit(df)
    hard, _, threshold, hard_reject = _difficulty(spark, sf_dir, rounds=10, cases=df)
    two, _ = fit_two_stage(df)
    return registry.save(spark, root, "case_models",
                         {"reject": reject, "hard": hard, "hard_reject": hard_reject, "stage1": two.stage1, "stage2": two.stage2},
                         {"thresholds": two.thresholds}, {"hard_threshold": threshold, "classes": two.classes})


def stored_models(run: registry.Run) -> CaseModels:
    """The models of a stored run."""
    two = TwoStage(run.model("stage1"), run.model("stage2"), run.record["classes"], run.table("thresholds"))
    return CaseModels(run.model("reject"), run.model("hard"), run.model("hard_reject"), run.record["hard_threshold"], two)


def score_cases(cases: DataFrame, m: CaseModels) -> DataFrame:
    """Scored cases: H5 (p_reject, percent, band), H6 (p_difficult,
    difficulty_pred), H9 (route) and H11 (stage1_pred to decision_conf), row by
    row.  The batch path, and what the stream does with each of its batches."""
    s = models.score_difficulty(m.hard, _difficulty_inputs(cases, m.hard_reject), DIFFICULTY_INPUTS, m.hard_threshold)
    s = decide_two_stage(s.drop("p_reject", "reject_bit", "price_per_nation", "log_price"), m.two_stage)
    s = s.withColumn("route", policy.auto_approve("stage2_class", "stage2_p", favourable=("1-URGENT", "2-HIGH")))
    return models.score_reject(m.reject, s).select(
        "case_id", "y", "p_reject", "percent", "band", "p_difficult", "difficulty_pred", "route", "stage1_pred", "stage1_p",
        "stage2_class", "stage2_p", "auto_decision", "decision_conf")


def scored_cases(spark, sf_dir):
    """All cases scored by the latest stored models."""
    root = f"{scratch_dir(spark)}/registry-{uuid.uuid4().hex}"
    cases = held_cases(spark, sf_dir)
    fit_case_models(spark, sf_dir, root, cases)
    return score_cases(cases, stored_models(registry.latest(spark, root, "case_models")))


def stream(spark, sf_dir):
    """The scoring stream over the order files, run until all that has
    arrived is scored; the columns are those of ``scored_cases``, by the same
    function and from stored models.  Customers are a static table."""
    t = Tables(spark, sf_dir)
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    m = stored_models(fit_case_models(spark, sf_dir, f"{base}/registry"))
    return score_stream(spark, sf_dir, t.orders.schema, f"{base}/out", f"{base}/ckpt",
                        lambda batch: score_cases(cases_from(batch, t.customer), m), file_filter="orders.parquet").drop("batch_id")


MODEL_QUERIES = {
    "reject_model": reject_model, "reject_report": reject_report, "importances": importances,
    "adasyn_rows": adasyn_rows, "weighted_forest": weighted_forest,
    "multiclass_forest": multiclass_forest, "difficulty_model": difficulty_model,
    "contributions": contributions, "served_rejects": served_rejects, "batch": batch, "batch_report": batch_report, "two_stage_job": two_stage_job, "stream": stream,
    "bootstrap_weights": bootstrap_weights, "bag_ratios": bag_ratios, "scored_cases": scored_cases, "reply_intake": reply_intake, "reply_outbox": reply_outbox,
}
