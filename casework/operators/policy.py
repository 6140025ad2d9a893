"""Decision policies (H9-H13, D21).  Row-wise ``when`` logic; thresholds
arrive as a small (stage, class, threshold) table that is broadcast-joined
(bounded by the number of classes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.clean import REJECT, PERMIT, squash_space

AUTO_APPROVE = "AUTO_APPROVE"
MANUAL_REVIEW = "MANUAL_REVIEW"
MANUAL = "manual_review"
# Favourable decision types, gate classes, rule exemptions.
FAVOURABLE = ("Utvidet bruk", "Varig tillatelse")
ALLOWED_POLICY_CLASSES = ("Lite streng", "Mindre streng")
RULE_EXEMPT_TYPES = ("Utvidet bruk", "Endret bruk")
RULE_OPEN_CLASS = "Lite streng"
RULE_SPEED = 60
SHARP_CURVE = "Krapp sving"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def auto_approve(pred, confidence, favourable=FAVOURABLE, threshold: float = 0.8) -> Column:
    """H9: favourable prediction with confidence >= threshold -> AUTO_APPROVE."""
    return F.when(_c(pred).isin(*favourable) & (_c(confidence) >= threshold),
                  F.lit(AUTO_APPROVE)).otherwise(F.lit(MANUAL_REVIEW))


def rule_reject(policy_class, speed, curve_category, application_type) -> Column:
    """Automatic rejection rule.

    Reject when the policy class is not the open class (missing counts as
    different), or when (speed > 60 or sharp curve) and the application type is
    not an exempt type (missing type counts as not exempt)."""
    not_open = ~_c(policy_class).eqNullSafe(F.lit(RULE_OPEN_CLASS))
    risky = F.coalesce(_c(speed) > RULE_SPEED, F.lit(False)) | \
        _c(curve_category).eqNullSafe(F.lit(SHARP_CURVE))
    exempt = F.coalesce(_c(application_type).isin(*RULE_EXEMPT_TYPES), F.lit(False))
    return not_open | (risky & ~exempt)


def gate_ok(policy_class, allowed=ALLOWED_POLICY_CLASSES) -> Column:
    """Normalised policy class is an allowed one (NULL -> blocked)."""
    return F.coalesce(squash_space(_c(policy_class)).isin(*allowed), F.lit(False))


def two_stage_decide(df: DataFrame, thresholds: DataFrame, pred1: str = "stage1_pred",
                     p1: str = "p_reject", top2: str = "stage2_class", p2: str = "stage2_p",
                     gate: Column | None = None) -> DataFrame:
    """Two-stage decision with per-class thresholds.

    ``thresholds``: (stage, class, threshold); stage 1 holds the reject
    threshold t1, stage 2 one threshold per class (NULL never fires).
    Stage 1 fires when pred1 = reject and p1 >= t1; otherwise rows predicted
    as permit take the stage-2 top class when its probability reaches that
    class's threshold; everything else goes to manual review.  ``gate`` (a
    boolean Column) must hold for either stage to fire.
    Adds (auto_decision, decision_conf)."""
    t1 = thresholds.where(F.col("stage") == 1).select(F.max("threshold")).scalar()
    t2 = thresholds.where(F.col("stage") == 2).select(
        F.col("class").alias("_c2"), F.col("threshold").alias("_t2"))
    g = gate if gate is not None else F.lit(True)
    x = (df.withColumn("_t1", t1)
         .join(t2, F.col(top2) == F.col("_c2"), "left"))
    fire1 = (F.col(pred1) == F.lit(REJECT)) & F.col("_t1").isNotNull() & \
        (F.col(p1) >= F.col("_t1")) & g
    fire2 = (F.col(pred1) == F.lit(PERMIT)) & F.col("_t2").isNotNull() & \
        (F.col(p2) >= F.col("_t2")) & g
    out = x.withColumn("auto_decision", F.when(fire1, F.lit(REJECT)).when(fire2, F.col(top2))
                       .otherwise(F.lit(MANUAL))) \
           .withColumn("decision_conf", F.when(fire1, F.col(p1)).when(fire2, F.col(p2)))
    return out.drop("_t1", "_c2", "_t2")


def policy_metrics(df: DataFrame, decision: str, truth: str, gate: str | None = None) -> DataFrame:
    """Auto count, accuracy among auto decisions, coverage, gate-blocked rows."""
    auto = F.col(decision) != F.lit(MANUAL)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(auto).alias("auto_n"),
            F.avg(F.when(auto, (F.col(decision) == F.col(truth)).cast("double"))).alias("auto_accuracy")]
    if gate:
        aggs.append(F.count_if(~F.col(gate)).alias("blocked"))
    a = df.agg(*aggs)
    cols = [F.col("n").cast("long").alias("n"), F.col("auto_n").cast("long").alias("auto_n"),
            F.round("auto_accuracy", 6).alias("auto_accuracy"),
            F.round(F.col("auto_n") / F.col("n"), 6).alias("coverage")]
    if gate:
        cols.append(F.col("blocked").cast("long").alias("blocked"))
    return a.select(*cols)
