"""Registered queries: the operators applied to the benchmark tables.

Each query takes (spark, sf_dir) and returns a DataFrame whose column names
match the oracle SQL in ``casework.plans.oracle``.  Stand-ins (which driver
column plays which case column) follow SURVEY §7.3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions import clean
from casework.operators import profile
from casework.sources.tables import Tables


def _decision(flag_col: str = "l_returnflag") -> F.Column:
    """Stand-in decision: return flag R plays a rejection."""
    return F.when(F.col(flag_col) == "R", F.lit(clean.REJECT)).otherwise(F.lit("Varig tillatelse"))


def outcome_crosstab_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14 + D6/D18: outcome share per category value, four category columns."""
    t = Tables(spark, sf_dir)
    # Pre-aggregate lineitem to (order, linestatus, outcome) before the join so
    # the join shuffles counts, not rows.
    li = (t.lineitem
          .select("l_orderkey", "l_linestatus",
                  clean.binary_outcome(_decision()).alias("outcome"))
          .groupBy("l_orderkey", "l_linestatus", "outcome").agg(F.count(F.lit(1)).alias("w")))
    od = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    cu = t.customer.select("c_custkey", "c_mktsegment")
    base = (li.join(od, li.l_orderkey == od.o_orderkey)
            .join(cu, od.o_custkey == cu.c_custkey))
    return profile.crosstab_pct(
        base, ["o_orderpriority", "o_orderstatus", "l_linestatus", "c_mktsegment"],
        "outcome", weight="w")



# ---------------------------------------------------------------- stand-ins
# lineitem as a case table: truth from the return flag, a synthetic
# prediction from the discount, correct/incorrect from both.

def _li_cases(t: Tables) -> DataFrame:
    li = t.lineitem
    truth = clean.binary_outcome(_decision())
    pred = F.when(F.col("l_discount") >= 0.05, F.lit(clean.REJECT)).otherwise(F.lit(clean.APPROVE))
    return (li.withColumn("truth", truth).withColumn("pred", pred)
            .withColumn("correct", F.when(F.col("truth") == F.col("pred"), F.lit("correct"))
                        .otherwise(F.lit("incorrect")))
            .withColumn("ship_year", F.year("l_shipdate").cast("string")))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def freq_by_outcome(spark, sf_dir):
    """C6 + D5."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.freq_by_outcome(df, ["l_linestatus", "ship_year"], "truth",
                                   [clean.REJECT, clean.APPROVE])


def profile_numeric(spark, sf_dir):
    """D7 per outcome."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.profile_numeric(df, _NUM, ["truth"])


def profile_mixed(spark, sf_dir):
    """D8 per outcome."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.profile_mixed(df, ["l_quantity", "l_extendedprice"],
                                 ["l_linestatus", "ship_year"], ["truth"])


def profile_by_confusion(spark, sf_dir):
    """Four cells + two margins."""
    df = _li_cases(Tables(spark, sf_dir))
    prof, _ = profile.profile_by_confusion(df, "truth", "pred", ["l_quantity", "l_tax"],
                                           ["l_linestatus"])
    return prof


def confusion_subset_counts(spark, sf_dir):
    """D9 + D4: value counts of a text column inside every confusion subset."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.value_counts(profile.confusion_subsets(df, "truth", "pred"), "ship_year", ["subset"])


def cardinality_gate(spark, sf_dir):
    """D10."""
    li = Tables(spark, sf_dir).lineitem
    return profile.cardinality_gate(li, ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey"])


def encode_gate(spark, sf_dir):
    """D10, the decision alone, from mergeable sketches in one scan; l_quantity
    has 50 values, the limit, and the line number, empty for 7, is a text."""
    line = F.when(F.col("l_linenumber") % 7 == 0, "").otherwise(F.col("l_linenumber").cast("string"))
    li = Tables(spark, sf_dir).lineitem.withColumn("line", line)
    return profile.encode_gate(li, ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_quantity", "line"], 50)


def corr_matrix(spark, sf_dir):
    """D11 over numerics, label-encoded low-cardinality text (G8) and a column without spread."""
    from casework.operators import features
    li = Tables(spark, sf_dir).lineitem
    enc = features.label_encode(li, ["l_returnflag", "l_linestatus"]).withColumn("constant", F.lit(5.5))
    return profile.corr_matrix(enc, _NUM + ["l_returnflag_code", "l_linestatus_code", "constant"])


def top_mean_diff(spark, sf_dir):
    """Columns whose means differ most between correct and incorrect."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.top_mean_diff(df, _NUM + ["l_linenumber"], "correct", "correct", "incorrect", k=3)


def score_quantiles(spark, sf_dir):
    """Quartiles of a score per outcome."""
    df = _li_cases(Tables(spark, sf_dir)).withColumn("score", F.col("l_discount") * 10)
    return profile.score_quantiles(df, "score", ["truth"]).select(
        "truth", *[F.round(c, 6).alias(c) for c in ["p25", "p50", "p75"]])


def box_stats(spark, sf_dir):
    """D15 per outcome."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.box_stats(df, "l_extendedprice", ["truth"])


def kde_grid(spark, sf_dir):
    """KDE of order totals per order status."""
    o = Tables(spark, sf_dir).orders
    return profile.kde_grid(o, "o_totalprice", ["o_orderstatus"], decimals=12)


def histogram_density(spark, sf_dir):
    """Correct vs incorrect density histogram."""
    df = _li_cases(Tables(spark, sf_dir))
    return profile.histogram_density(df, "l_extendedprice", "correct", bins=20)


def _orders_cases(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


def facet_options(spark, sf_dir):
    """Distinct facet values."""
    df = _orders_cases(Tables(spark, sf_dir))
    return profile.facet_options(df, ["o_orderpriority", "o_orderstatus", "c_mktsegment"])


def facet_bounds(spark, sf_dir):
    """Integer slider bounds."""
    df = _orders_cases(Tables(spark, sf_dir))
    return profile.facet_bounds(df, ["o_totalprice", "c_acctbal"])


# ---------------------------------------------------------------- evaluation
_LABELS = [clean.APPROVE, clean.REJECT]


def _li_eval(t: Tables) -> DataFrame:
    """Predictions with an error label where the tax is 0 (excluded by B35)."""
    df = _li_cases(t)
    return df.withColumn("pred2", F.when(F.col("l_tax") == 0, F.lit(clean.ERROR))
                         .otherwise(F.col("pred")))


def confusion(spark, sf_dir):
    """D19 with B35 (only valid labels)."""
    from casework.operators import evaluate
    return evaluate.confusion(_li_eval(Tables(spark, sf_dir)), "truth", "pred2", _LABELS)


def class_report(spark, sf_dir):
    """B35 + D20 on valid predictions."""
    from casework.operators import evaluate
    df = _li_eval(Tables(spark, sf_dir)).where(F.col("pred2").isin(*_LABELS))
    return evaluate.class_report(df, "truth", "pred2")


def _li_auto(t: Tables) -> DataFrame:
    li = t.lineitem
    lab = (F.when(F.col("l_returnflag") == "A", F.lit("Utvidet bruk"))
           .when(F.col("l_returnflag") == "N", F.lit("Varig tillatelse")).otherwise(F.lit(clean.REJECT)))
    return (li.withColumn("pred_label", lab)
            .withColumn("confidence", F.lit(1.0) - F.col("l_discount") * 5)
            .withColumn("true_label", F.when(F.col("l_linestatus") == "O", F.col("pred_label"))
                        .otherwise(F.lit(clean.REJECT))))


def auto_approve(spark, sf_dir):
    """H9: auto-approve rule counts."""
    from casework.operators import policy
    df = _li_auto(Tables(spark, sf_dir))
    d = df.withColumn("decision", policy.auto_approve("pred_label", "confidence"))
    return d.groupBy("pred_label", "decision").agg(F.count(F.lit(1)).alias("n"))


def high_conf_report(spark, sf_dir):
    """Class report on predictions with confidence >= 0.8."""
    from casework.operators import evaluate
    df = _li_auto(Tables(spark, sf_dir)).where(F.col("confidence") >= 0.8)
    return evaluate.class_report(df, "true_label", "pred_label")


def class_ratio(spark, sf_dir):
    """negative/positive ratio of the reject label."""
    from casework.operators import evaluate
    df = _li_cases(Tables(spark, sf_dir)).withColumn(
        "y", (F.col("truth") == clean.REJECT).cast("int"))
    return evaluate.class_ratio(df, "y", 1)


def _ev_scores(t: Tables) -> DataFrame:
    ev = t.events
    return (ev.withColumn("p", F.col("value") / 490)
            .withColumn("hit", (F.col("value") > 200).cast("int"))
            .withColumn("predicted", F.col("event_type") != "view")
            .withColumn("true_class", F.when(F.col("value") > 245, F.col("event_type"))
                        .otherwise(F.lit("other"))))


def precision_threshold(spark, sf_dir):
    """Reject threshold reaching 90 % precision."""
    from casework.operators import evaluate
    df = _ev_scores(Tables(spark, sf_dir))
    return evaluate.precision_threshold(df, "p", "hit", predicted="predicted", target=0.9)


def class_thresholds(spark, sf_dir):
    """One threshold per predicted class (95 % precision); a class that is
    never predicted gets NULL."""
    from casework.operators import evaluate
    df = _ev_scores(Tables(spark, sf_dir)).withColumn(
        "hit2", (F.col("true_class") == F.col("event_type")).cast("int"))
    classes = df.select(F.col("true_class").alias("class")).distinct()
    return evaluate.precision_threshold(df, "p", "hit2", by="event_type", target=0.95,
                                        classes=classes)


def grid_threshold(spark, sf_dir):
    """NPV/recall-floored grid threshold."""
    from casework.operators import evaluate
    li = Tables(spark, sf_dir).lineitem
    df = li.select((F.col("l_discount") * 10).alias("p"),
                   (((F.col("l_discount") >= 0.05) & (F.col("l_quantity") > 10)) |
                    (F.col("l_quantity") < 3)).cast("int").alias("y"))
    return evaluate.grid_threshold(df, "p", "y")


# Fixed parameters of the policy stand-in: t1 and per-class t2 (NULL never fires).
POLICY_THRESHOLDS = [(1, "Avslag", 0.8, 0.99), (2, "1-URGENT", 0.5, 0.99),
                     (2, "2-HIGH", 0.9, 0.99), (2, "3-MEDIUM", None, 0.99),
                     (2, "4-NOT SPECIFIED", 0.7, 0.99), (2, "5-LOW", 0.3, 0.99)]


def _policy_input(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_discount", "l_tax", "l_returnflag")
    od = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    df = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    return (df.withColumn("p_reject", F.col("l_discount") * 10)
            .withColumn("stage1_pred", F.when(F.col("l_discount") >= 0.05, F.lit(clean.REJECT))
                        .otherwise(F.lit(clean.PERMIT)))
            .withColumn("stage2_class", F.col("o_orderpriority"))
            .withColumn("stage2_p", F.lit(1.0) - F.col("l_tax") * 10)
            .withColumn("truth", F.when(F.col("l_returnflag") == "R", F.lit(clean.REJECT))
                        .otherwise(F.col("o_orderpriority")))
            .withColumn("policy_class", F.when(F.col("o_orderstatus") == "F", F.lit(" Lite  streng"))
                        .when(F.col("o_orderstatus") == "O", F.lit("Mindre streng "))
                        .otherwise(F.lit("Streng"))))


def _thresholds(spark):
    from casework.sources.cases import THRESHOLD_SCHEMA
    return spark.createDataFrame(POLICY_THRESHOLDS, THRESHOLD_SCHEMA)


def two_stage_policy(spark, sf_dir):
    """Decisions per outcome with mean confidence."""
    from casework.operators import policy
    df = policy.two_stage_decide(_policy_input(Tables(spark, sf_dir)), _thresholds(spark))
    return df.groupBy("auto_decision").agg(F.count(F.lit(1)).alias("n"),
                                           F.round(F.avg("decision_conf"), 6).alias("mean_conf"))


def two_stage_metrics(spark, sf_dir):
    """H11 + D21: auto count, accuracy, coverage."""
    from casework.operators import policy
    df = policy.two_stage_decide(_policy_input(Tables(spark, sf_dir)), _thresholds(spark))
    return policy.policy_metrics(df, "auto_decision", "truth")


def gated_policy(spark, sf_dir):
    """H12 + D21: the same policy behind the policy-class gate."""
    from casework.operators import policy
    df = _policy_input(Tables(spark, sf_dir)).withColumn("gate_ok", policy.gate_ok("policy_class"))
    d = policy.two_stage_decide(df, _thresholds(spark), gate=F.col("gate_ok"))
    return policy.policy_metrics(d, "auto_decision", "truth", gate="gate_ok")


def rule_reject(spark, sf_dir):
    """Rule-based rejection counts per policy class and application type."""
    from casework.operators import policy
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    od = t.orders.select("o_orderkey", "o_orderstatus")
    df = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    df = (df.withColumn("policy_class", F.when(F.col("o_orderstatus") == "F", F.lit("Lite streng"))
                        .when(F.col("o_orderstatus") == "O", F.lit("Mindre streng"))
                        .otherwise(F.lit(None).cast("string")))
          .withColumn("speed", F.col("l_quantity") + 40)
          .withColumn("curve", F.when(F.col("l_linenumber") == 1, F.lit("Krapp sving"))
                      .otherwise(F.lit("Rett veg")))
          .withColumn("application_type", F.when(F.col("l_returnflag") == "A", F.lit("Utvidet bruk"))
                      .when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
                      .otherwise(F.lit("Ny avkjørsel"))))
    df = df.withColumn("reject", policy.rule_reject("policy_class", "speed", "curve",
                                                    "application_type"))
    return df.groupBy("policy_class", "application_type", "reject").agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- annotations
# base = all orders keyed by customer; annotations = events keyed by user, value = event type with 'error' as a missing annotation, order = id.

def _ann_inputs(t: Tables):
    base = t.orders.select("o_orderkey", F.col("o_custkey").alias("case_id"))
    ann = t.events.select(F.col("user_id").alias("case_id"), "event_id",
                          F.when(F.col("event_type") != "error", F.col("event_type")).alias("difficulty"))
    return base, ann


def merge_annotations(spark, sf_dir):
    """C1 + D1: last non-null annotation per key onto every base row."""
    from casework.operators import annotate
    base, ann = _ann_inputs(Tables(spark, sf_dir))
    return annotate.merge_annotations(base, ann, ["case_id", "case_number"], "difficulty", "event_id")


def unmatched_keys(spark, sf_dir):
    """Annotation keys without a base row."""
    from casework.operators import annotate
    base, ann = _ann_inputs(Tables(spark, sf_dir))
    return annotate.unmatched_keys(base, ann, ["case_id"])


def duplicate_keys(spark, sf_dir):
    """Keys repeated in the base, with their annotation counts."""
    from casework.operators import annotate
    base, ann = _ann_inputs(Tables(spark, sf_dir))
    return annotate.duplicate_keys(base, ann, ["case_id"])


def duplicate_annotations(spark, sf_dir):
    """The annotation rows of keys that the base repeats."""
    from casework.operators import annotate
    base, ann = _ann_inputs(Tables(spark, sf_dir))
    return annotate.duplicate_annotations(base, ann, ["case_id"], "difficulty", "event_id")


def reconcile(spark, sf_dir):
    """D3: reconciliation counts of the merge."""
    from casework.operators import annotate
    base, ann = _ann_inputs(Tables(spark, sf_dir))
    merged = annotate.merge_annotations(base, ann, ["case_id"], "difficulty", "event_id")
    return annotate.reconcile(base, ann, merged, ["case_id"], "difficulty", "difficulty")


# ---------------------------------------------------------------- enrichment

def lookup_attribute(spark, sf_dir):
    """A12 + B29 + C4: property 'k' of each customer's first event (events as
    road objects with a property array parsed from JSON); none -> ''."""
    from casework.operators import enrich
    t = Tables(spark, sf_dir)
    props = F.transform(F.map_entries(F.from_json("props", "map<string,string>")),
                        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    objects = t.events.select("user_id", "event_id", props.alias("properties"))
    cases = t.customer.select("c_custkey", "c_mktsegment")
    return enrich.lookup_attribute(cases, objects, "c_custkey", "user_id", "event_id", "k", "k_value")


def lookup_first_line(spark, sf_dir):
    """C4: quantity of the first line item (total order over all columns) of
    each part; parts without lines -> ''."""
    from casework.operators import enrich
    t = Tables(spark, sf_dir)
    li = t.lineitem
    order = F.struct(*[F.col(c) for c in li.columns])
    first = li.groupBy("l_partkey").agg(F.min_by(F.col("l_quantity"), order).alias("qty"))
    j = t.part.select("p_partkey").join(first, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", F.coalesce(F.col("qty").cast("string"), F.lit("")).alias("first_qty"))


def count_within(spark, sf_dir):
    """Line items of the same part whose extended price lies within +-500."""
    from casework.operators import enrich
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                                               "l_extendedprice")
    return enrich.count_within(li, li, "l_partkey", "l_extendedprice", "l_partkey",
                               "l_extendedprice", 500.0)


def count_events_nearby(spark, sf_dir):
    """C5 on time: events of the same user within +-60 s of each event."""
    from casework.operators import enrich
    ev = Tables(spark, sf_dir).events.select(
        "event_id", "user_id",
        (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
         / 1e6).alias("sec"))
    out = enrich.count_within(ev, ev, "user_id", "sec", "user_id", "sec", 60.0)
    return out.select("event_id", "user_id", "n_within")


# ---------------------------------------------------------------- cleaning

NBSP = "\u00a0"


def clean_parse_numbers(spark, sf_dir):
    """Locale text -> number, whitespace-squashed category, dedup."""
    from casework.functions import derive  # noqa: F401
    li = Tables(spark, sf_dir).lineitem
    txt = F.concat(F.lit(" "), F.translate(F.format_number("l_extendedprice", 2), ",.", "\u00a0,"),
                   F.lit(" "))
    txt = F.when(F.col("l_linenumber") == 7, F.lit("abc")).otherwise(txt)
    cat = F.concat(F.lit(" "), F.col("l_returnflag"), F.lit("   "), F.col("l_linestatus"))
    df = li.select(clean.parse_number(F.trim(txt)).alias("price"),
                   clean.squash_space(cat).alias("category"),
                   clean.binary_outcome(_decision()).alias("truth"))
    return df.dropDuplicates(["price", "category", "truth"])


def curve_category(spark, sf_dir):
    """B17 + B18: curve categories and display labels from a signed radius."""
    from casework.functions import derive
    p = Tables(spark, sf_dir).part
    r = F.when(F.col("p_size") != 1, F.round((F.col("p_retailprice") - 950) * 100, 1))
    df = p.select("p_partkey", r.alias("radius"))
    cat = derive.curve_category("radius")
    return df.select("p_partkey", cat.alias("curve_category"),
                     derive.turn_label(cat, F.col("radius")).alias("turn_label"))


def curve_category_counts(spark, sf_dir):
    """B17 + D4: value counts of the coarse curve class."""
    from casework.functions import derive
    p = Tables(spark, sf_dir).part
    r = F.when(F.col("p_size") != 1, F.round((F.col("p_retailprice") - 950) * 100, 1))
    cat = derive.curve_category(r)
    coarse = F.regexp_replace(cat, r" \(svingradius .*\)$", "")
    return profile.value_counts(p.select(coarse.alias("curve_class")), "curve_class")


def risk_band(spark, sf_dir):
    """B19 on probability and percent scale."""
    from casework.functions import derive
    li = Tables(spark, sf_dir).lineitem
    p = F.col("l_discount") * 5
    df = li.select(derive.risk_band(p).alias("band"),
                   derive.risk_band(F.round(p * 100, 1), scale=100).alias("band_pct"))
    return df.groupBy("band", "band_pct").agg(F.count(F.lit(1)).alias("n"))


def derived_features(spark, sf_dir):
    """Engineered and serving features."""
    from casework.functions import derive
    li = Tables(spark, sf_dir).lineitem
    aadt, acc = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    share, speed = F.col("l_discount") * 100, F.col("l_tax") * 1000
    grad, radius = F.col("l_discount") - 0.05, F.col("l_partkey") * 50
    cols = [derive.per_access(aadt, acc).alias("per_access"), F.log1p(aadt).alias("log_aadt"),
            F.abs(grad).alias("abs_gradient"),
            derive.curve_indicator(radius).alias("curve_ind"),
            derive.gradient_indicator(grad).alias("gradient_ind"),
            derive.curve_sigmoid(radius).alias("curve_sigmoid"),
            derive.long_vehicles(aadt, share).alias("long_vehicles"),
            *derive.serving_features(aadt, share, speed, acc, grad)]
    df = li.select("l_orderkey", "l_linenumber", *cols)
    return df.select("l_orderkey", "l_linenumber",
                     *[(F.round(c, 9) if c in ("log_aadt", "curve_sigmoid") else F.col(c)).alias(c)
                       for c in df.columns[2:]])


def _facet_input(t: Tables) -> DataFrame:
    from casework.functions import derive
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return df.withColumn("received_text", F.date_format("o_orderdate", "dd.MM.yyyy")) \
             .withColumn("received", derive.received_date("received_text"))


def facet_filter(spark, sf_dir):
    """B23 + B24 + B25: faceted subset with display labels."""
    from casework.functions import derive
    from casework.operators import browse
    df = _facet_input(Tables(spark, sf_dir))
    pred = browse.facet_predicate(
        facets={"o_orderpriority": ["1-URGENT", "2-HIGH"], "c_mktsegment": ["BUILDING", "MACHINERY"],
                "o_orderstatus": []},
        ranges={"o_totalprice": (50000, 300000), "c_acctbal": (0, 8000)},
        since=("received", "1997-01-01"))
    sub = df.where(pred)
    label = derive.display_label(F.col("o_orderkey"), "c_mktsegment", "o_orderpriority",
                                 F.col("c_nationkey"), "received_text")
    return sub.select("o_orderkey", "o_custkey", label.alias("display_label"))


_ROW_KEY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def row_lookup(spark, sf_dir):
    """B4 + B26: the orders whose id is that of each customer's largest order key."""
    from casework.operators import browse
    o = Tables(spark, sf_dir).orders
    df = browse.with_row_id(o, _ROW_KEY)
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct(*_ROW_KEY), "o_orderkey").alias("k"))
    picks = last.select(browse.row_id_of([F.col(f"k.{c}").cast("string") for c in _ROW_KEY]).alias("pick"))
    return df.join(picks, df.row_id == picks.pick, "left_semi").select("row_id", "o_orderkey", "o_totalprice")


def _gappy(t: Tables) -> DataFrame:
    """Line items with missing cells, reduced to few columns so that rows repeat."""
    return t.lineitem.select(F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"),
                             F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")).alias("status"),
                             F.col("l_linenumber").alias("line"))


def row_ids(spark, sf_dir):
    """Ids of orders by key, NULL key parts included (stable under retries)."""
    from casework.operators import browse
    o = Tables(spark, sf_dir).orders.withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return browse.with_row_id(o, _ROW_KEY).select("o_orderkey", "row_id")


def row_ids_repeated(spark, sf_dir):
    """Ids without a key; equal rows get an id each."""
    from casework.operators import browse
    return browse.with_row_id(_gappy(Tables(spark, sf_dir)))


# ---------------------------------------------------------------- sampling

def _orders_lab(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.withColumn("label", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(clean.REJECT))
                        .otherwise(F.lit(clean.PERMIT)))


def hash_split(spark, sf_dir):
    """G1: 60/40 split by arithmetic hash."""
    from casework.operators import sample
    o = _orders_lab(Tables(spark, sf_dir))
    return sample.hash_split(o, "o_orderkey", (0.6, 0.4), seed=42).select("o_orderkey", "split")


def stratified_split(spark, sf_dir):
    """20 % test per order status."""
    from casework.operators import sample
    o = _orders_lab(Tables(spark, sf_dir))
    return sample.stratified_split(o, "o_orderkey", ["o_orderstatus"], 0.2, seed=7) \
        .select("o_orderkey", "o_orderstatus", "split")


def nested_split(spark, sf_dir):
    """G2 nested: 20 % test by label, then 20 % validation by priority inside train."""
    from casework.operators import sample
    o = _orders_lab(Tables(spark, sf_dir))
    outer = sample.stratified_split(o, "o_orderkey", ["label"], 0.2, seed=11)
    train = outer.where(F.col("split") == "train").drop("split")
    inner = sample.stratified_split(train, "o_orderkey", ["o_orderpriority"], 0.2, seed=13,
                                    names=("train", "val"))
    return outer.where(F.col("split") == "test").select("o_orderkey", "split") \
        .unionByName(inner.select("o_orderkey", "split"))


def balanced_sample(spark, sf_dir):
    """All rejects + twice as many permits."""
    from casework.operators import sample
    o = _orders_lab(Tables(spark, sf_dir))
    return sample.balanced_sample(o, "o_orderkey", "label", clean.REJECT, 2.0, seed=5) \
        .select("o_orderkey", "label")


def oversample(spark, sf_dir):
    """Minority replicated to parity (train part of a hash split)."""
    from casework.operators import sample
    o = sample.hash_split(_orders_lab(Tables(spark, sf_dir)), "o_orderkey", (0.8, 0.2), seed=3)
    tr = o.where(F.col("split") == "train").drop("split")
    return sample.oversample(tr, "o_orderkey", "label", seed=9).select("o_orderkey", "label", "copy")


def balanced_bags(spark, sf_dir):
    """Three class-balanced bags."""
    from casework.operators import sample
    o = _orders_lab(Tables(spark, sf_dir))
    return sample.balanced_bags(o, "o_orderkey", "label", clean.REJECT, bags=3, ratio=1.0, seed=100) \
        .select("bag", "o_orderkey", "label")


def stage2_pool(spark, sf_dir):
    """True permits of the training split."""
    from casework.operators import sample
    o = sample.hash_split(_orders_lab(Tables(spark, sf_dir)), "o_orderkey", (0.6, 0.4), seed=42)
    return sample.stage2_pool(o, "split", "label").select("o_orderkey", "o_orderpriority")


# ---------------------------------------------------------------- features

def one_hot(spark, sf_dir):
    """One column per category value; missing -> all zeros."""
    from casework.operators import features
    li = Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus")
    return features.one_hot(li, ["l_returnflag", "l_linestatus"])


def one_hot_unseen(spark, sf_dir):
    """Vocabulary learned on the training rows; unseen values -> zeros."""
    from casework.operators import features
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    vocab = {"o_orderstatus": features.vocabulary(o.where(F.col("o_orderstatus") != "P"),
                                                  "o_orderstatus")}
    enc = features.one_hot(o, ["o_orderstatus"], vocab=vocab, drop_source=False)
    return enc.groupBy("o_orderstatus", "o_orderstatus_F", "o_orderstatus_O").agg(
        F.count(F.lit(1)).alias("n"))


def label_encode(spark, sf_dir):
    """Sorted classes -> codes and back."""
    from casework.operators import features
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    enc = features.label_encode(o, ["o_orderpriority", "o_orderstatus"])
    classes = features.vocabulary(o, "o_orderpriority")
    return enc.withColumn("decoded", features.label_decode("o_orderpriority_code", classes)) \
        .select("o_orderkey", "o_orderpriority_code", "o_orderstatus_code", "decoded")


def zscore(spark, sf_dir):
    """Z-scores with population std (NULLs filled with 0 first)."""
    from casework.operators import features
    li = Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"))
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    z = features.zscore(li, cols)
    return z.select("l_orderkey", "l_linenumber", *[F.round(c + "_z", 6).alias(c + "_z") for c in cols])


def interactions3(spark, sf_dir):
    """All products of 1..3 distinct inputs."""
    from casework.operators import features
    li = Tables(spark, sf_dir).lineitem
    return features.interactions(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], 3,
                                 keep=["l_orderkey"])


def _impute_input(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", F.when(F.col("l_quantity") != 25, F.col("l_quantity")).alias("l_quantity"),
        "l_discount",
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("l_linestatus"),
        "l_returnflag")


def impute_stats(spark, sf_dir):
    """Exact medians and most frequent values."""
    from casework.operators import features
    return features.impute_stats(_impute_input(Tables(spark, sf_dir)), ["l_quantity", "l_discount"],
                                 ["l_linestatus", "l_returnflag"])


def impute(spark, sf_dir):
    """Fills applied; totals per filled category."""
    from casework.operators import features
    df = features.impute(_impute_input(Tables(spark, sf_dir)), ["l_quantity", "l_discount"],
                         ["l_linestatus", "l_returnflag"])
    return df.groupBy("l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"),
                                          F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- retrieval

_SIM_FEATS = ["f_price", "f_acctbal", "f_days", "f_nation"]


def _sim_cases(t: Tables) -> DataFrame:
    from casework.operators import features
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("policy_class"),
                  F.col("c_mktsegment").alias("purpose"),
                  F.when(F.col("o_orderstatus") == "P", F.lit(clean.REJECT)).otherwise(F.lit(clean.APPROVE))
                  .alias("label"),
                  F.col("o_totalprice").alias("f_price"), F.col("c_acctbal").alias("f_acctbal"),
                  F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
                  .cast("double").alias("f_days"),
                  F.col("c_nationkey").cast("double").alias("f_nation"))
    z = features.zscore(df, _SIM_FEATS, suffix="")
    return z


def similar_cases(spark, sf_dir):
    """C8 + E1 + F5: two nearest approved examples per case under the
    segment cascade (grid path forced on by a low direct-scan limit)."""
    from casework.operators import similar
    df = _sim_cases(Tables(spark, sf_dir))
    out = similar.similar_cases(df, "case_id", "label", clean.APPROVE, "policy_class", "purpose",
                                _SIM_FEATS, k=2, max_brute=200)
    return out.withColumn("distance", F.round("distance", 6))


def similar_cases_default(spark, sf_dir):
    """C8 + E1 + F5 as `similar_cases`, with the library's own direct-scan limit."""
    from casework.operators import similar
    df = _sim_cases(Tables(spark, sf_dir))
    out = similar.similar_cases(df, "case_id", "label", clean.APPROVE, "policy_class", "purpose", _SIM_FEATS, k=2)
    return out.withColumn("distance", F.round("distance", 6))


def reject_examples(spark, sf_dir):
    """The shared rejected examples (all rejects; self removed at use)."""
    from casework.operators import similar
    return similar.reject_examples(_sim_cases(Tables(spark, sf_dir)), "case_id", "label", clean.REJECT)


# ---------------------------------------------------------------- text

def _order_text(t: Tables) -> DataFrame:
    from casework.functions import text
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
                        .alias("o_orderpriority"))
    return o.select("o_orderkey", text.format_case(o, hidden=["o_custkey"]).alias("case_text"))


def case_text(spark, sf_dir):
    """Case rows as 'name: value' text."""
    return _order_text(Tables(spark, sf_dir))


def prompt(spark, sf_dir):
    """B31 + C8 + E2 + F1: prompts with the two nearest approved examples in
    distance order; guideline text and rejected examples referenced by id."""
    from casework.functions import text
    t = Tables(spark, sf_dir)
    ct = _order_text(t)
    sim = similar_cases(spark, sf_dir)
    ex = (sim.join(ct.select(F.col("o_orderkey").alias("example_id"), F.col("case_text").alias("ex_text")),
                   "example_id")
          .withColumn("block", text.example_block("ex_text", F.lit(True))))
    per_case = ex.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_ex"))
    per_case = per_case.select("case_id", F.transform("_ex", lambda x: x["block"]).alias("examples"))
    guide = t.documents.where(F.col("source") == "src0").select(F.min("doc_id")).scalar()
    base = ct.join(per_case, ct.o_orderkey == per_case.case_id, "left") \
             .withColumn("guideline_id", guide)
    return base.select("o_orderkey", text.build_prompt(
        F.lit(None).cast("string"), "case_text",
        F.coalesce("examples", F.array().cast("array<string>")), "guideline_id",
        "reject_examples").alias("prompt"))


# Replies as they come: clean, fenced, cut off, with text after them, not JSON, odd types.
REPLIES = [
    '{"approve": true, "reason": "ok"}', '{"approve": false}', '```json\n{"approve": true}\n```', '\n{"approve": true, "reason": "a"}\n',
    '\n```json\n{"approve": true}\n```\n', '```\n{"approve": false, "reason": "kort"}```', '{bad', '{"approve": true, "reas',
    '{"approve": true} extra', '{"approve": true}] extra}', '{"approve": true},{"approve": true}', '{"approve": "yes"}', '{"approve": 1}',
    '{"approve": 0}', '{"approve": "false"}', '{"approve": ""}', '{"approve": null}', '{"reason": "none"}', '[1]', 'true', '',
    ' \t ', '{"approve": []}', '{"approve": [0]}', '{"approve": {}}', '{"approve": 0.5, "reason": 5}', "{'approve': true}",
]


def _replies(t: Tables) -> DataFrame:
    """Each turn's reply: its text in the first turn, else one of ``REPLIES`` by its place."""
    c = t.conversations
    which = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3 + F.length("text"), F.lit(len(REPLIES))).cast("int")
    picked = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), which + 1)
    reply = F.when(F.col("turn") == 1, F.col("text")).otherwise(picked)
    err = F.when((F.col("turn") == 3) & (F.col("role") == "assistant"), F.lit("timeout"))
    return c.select("conv_id", "turn", reply.alias("reply"), err.alias("error"))


def parse_reply(spark, sf_dir):
    """B32 + B33 + B35: strict and lenient reply parsing, validity mask."""
    from casework.functions import text
    r = _replies(Tables(spark, sf_dir))
    dec, reason = text.parse_reply_strict("reply", "error")
    lenient = text.parse_reply_lenient("reply", "error")
    return r.select("conv_id", "turn", dec.alias("strict_decision"), reason.alias("strict_reason"),
                    lenient.alias("lenient_decision"),
                    text.valid_prediction(dec).alias("strict_valid"))


def explanation_text(spark, sf_dir):
    """B19 + B34 + E4: explanation text from per-feature contributions."""
    from casework.functions import text
    li = Tables(spark, sf_dir).lineitem
    cq = (F.col("l_quantity") - 25) / 100
    cd = (F.col("l_discount") - 0.05) * 2
    ct = (F.col("l_tax") - 0.04) * 3
    cp = F.floor((F.col("l_extendedprice") - 50000) / 1000) / 1000
    fac = F.array(
        F.struct(F.lit("antall").alias("name"), F.col("l_quantity").alias("value"), cq.alias("contribution")),
        F.struct(F.lit("rabatt").alias("name"), F.col("l_discount").alias("value"), cd.alias("contribution")),
        F.struct(F.lit("avgift").alias("name"), F.col("l_tax").alias("value"), ct.alias("contribution")),
        F.struct(F.lit("pris").alias("name"), F.col("l_extendedprice").alias("value"), cp.alias("contribution")))
    p = F.least(F.greatest(F.lit(0.1) + cq + cd + ct + cp, F.lit(0.0)), F.lit(1.0))
    return li.select("l_orderkey", "l_linenumber", text.explanation_text(p, fac).alias("explanation"))


def application_type(spark, sf_dir):
    """Application type from the decision, rejects filled from overrides
    (override rows derived from the urgent orders)."""
    from casework.operators import enrich
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cases = o.select("o_orderkey",
                     F.when(F.col("o_orderstatus") == "F", F.lit("Avslag"))
                     .when(F.col("o_orderstatus") == "O", F.lit("Varig tillatelse"))
                     .otherwise(F.lit("Utvidet bruk")).alias("decision"),
                     F.concat(F.lit("arkiv/"), F.col("o_orderkey").cast("string")).alias("archive_url"))
    ov = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat(F.lit("arkiv/"), F.col("o_orderkey").cast("string")).alias("archive_url"),
        F.lit("Endret bruk").alias("application_type"))
    out = enrich.application_type(cases, ov)
    return out.groupBy("decision", "application_type").agg(F.count(F.lit(1)).alias("n"))


def sparse_prune(spark, sf_dir):
    """B7 + B10: per-outcome sparse-column prune (>= 10 non-null values in
    every outcome group), after trimming the text cells."""
    li = Tables(spark, sf_dir).lineitem
    df = li.select(clean.binary_outcome(_decision()).alias("truth"), "l_orderkey", "l_quantity",
                   F.concat(F.lit(" "), F.col("l_linestatus"), F.lit(" ")).alias("status_txt"),
                   F.when(F.col("l_orderkey") < 3, F.lit("sjelden")).alias("rare_note"),
                   F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("approved_only"))
    return clean.drop_sparse_columns(clean.trim_strings(df), min_non_null=10, by="truth")


def quality_report(spark, sf_dir):
    """D19/D20 on the labelled documents: a length rule as the prediction of
    the quality label (labels x documents)."""
    from casework.operators import evaluate
    t = Tables(spark, sf_dir)
    df = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    df = df.select(F.col("quality").cast("string").alias("truth"),
                   F.when(F.col("n_chars") >= 1500, F.lit("1")).otherwise(F.lit("0")).alias("pred"))
    return evaluate.class_report(df, "truth", "pred")


EMB_DIM = 64


def similar_embeddings(spark, sf_dir):
    """C8/E1 on vectors: the three nearest embeddings with the same label
    (exact grid-pruned search, grid forced by a low direct-scan limit)."""
    return _nearest_embeddings(spark, sf_dir, max_brute=20)


def similar_embeddings_default(spark, sf_dir):
    """C8/E1 on vectors as `similar_embeddings`, with the library's own direct-scan limit."""
    return _nearest_embeddings(spark, sf_dir)


def _nearest_embeddings(spark, sf_dir, **limits):
    from casework.operators import similar
    e = Tables(spark, sf_dir).embeddings
    feats = [f"e{i}" for i in range(EMB_DIM)]
    cols = [F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)]
    base = e.select("vec_id", F.col("label").cast("string").alias("seg"), *cols)
    q = base.select(F.col("vec_id").alias("qid"), "seg", *[F.col(f).alias("q_" + f) for f in feats])
    p = base.select(F.col("vec_id").alias("nid"), "seg", *[F.col(f).alias("p_" + f) for f in feats])
    out = similar.knn(q, p, feats, 3, **limits)
    return out.select(F.col("qid").alias("vec_id"), F.col("nid").alias("neighbor_id"),
                      F.round("dist", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


def annotated_counts(spark, sf_dir):
    """B5 + D4: merged cases that carry an annotation, counted per value."""
    from casework.operators import annotate
    base, ann = _ann_inputs(Tables(spark, sf_dir))
    merged = annotate.merge_annotations(base, ann, ["case_id"], "difficulty", "event_id")
    return profile.value_counts(merged.where(clean.has_label("difficulty")), "difficulty")


def reject_rate(spark, sf_dir):
    """Numeric reject target from both reject spellings, in cells with stray
    white space, rate per priority."""
    o = Tables(spark, sf_dir).orders
    dec = (F.when(F.col("o_orderstatus") == "F", F.lit("Avslag"))
           .when(F.col("o_orderstatus") == "P", F.concat(F.lit("\tAvslag etter klage"), F.element_at(
               F.array(F.lit(""), F.lit(" "), F.lit("\u00a0"), F.lit("\n")), (F.col("o_orderkey") % 4 + 1).cast("int"))))
           .otherwise(F.lit("Varig tillatelse")))
    df = o.select("o_orderpriority", clean.reject_flag(dec).alias("y"))
    return df.groupBy("o_orderpriority").agg(F.sum("y").cast("long").alias("n_reject"),
                                             F.round(F.avg("y"), 6).alias("reject_rate"))


def count_within_ref(spark, sf_dir):
    """B28 + C5 end to end: cases carry a linear reference text
    ('P<part> S1D1 m<price>', every 5th with a ' K1' suffix), points are
    (road, meter) rows; the reference is parsed and points within 500 m are
    counted."""
    from casework.operators import enrich
    li = Tables(spark, sf_dir).lineitem
    road = F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit(" S1D1"))
    ref = F.concat(road, F.lit(" m"), F.col("l_extendedprice").cast("string"),
                   F.when(F.col("l_linenumber") == 5, F.lit(" K1")).otherwise(F.lit("")))
    cases = li.select("l_orderkey", "l_linenumber", ref.alias("road_ref"))
    points = li.select(road.alias("road"), F.col("l_extendedprice").alias("meter"))
    return enrich.count_within_ref(cases, points, "road_ref", 500.0)


def lookup_by_reference(spark, sf_dir):
    """A12 + B29 + C4 on a road-object snapshot built from orders: each order
    is an object of type 540 with two properties on its customer's 'road', a
    point or (every third) an extent of 400 m; each customer is a case at
    m500, every fifth without a meter.  The case gets both properties of the
    first object there (by order key); none -> ''."""
    from casework.operators import enrich
    t = Tables(spark, sf_dir)
    o = t.orders
    meter = (F.col("o_orderkey") % 10 * 100).cast("double")
    objects = o.select(
        F.lit(540).alias("object_type"), F.col("o_orderkey").alias("object_id"), F.col("o_orderkey").alias("ord"),
        F.array(F.struct(F.lit("Prioritet").alias("name"), F.col("o_orderpriority").alias("value")),
                F.struct(F.lit("Status").alias("name"), F.col("o_orderstatus").alias("value"))).alias("properties"),
        F.array(F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("road"), meter.alias("meter"),
                         F.when(F.col("o_orderkey") % 3 == 0, meter + 400).alias("meter_to"))).alias("references"))
    ref = F.concat(F.lit("C"), F.col("c_custkey").cast("string"),
                   F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.lit(" m500")))
    cases = t.customer.select("c_custkey", ref.alias("road_ref"))
    return enrich.lookup_by_reference(cases, objects, 540, {"priority": "Prioritet", "status": "Status"})


def lookup_along_road(spark, sf_dir):
    """C4 with extents of all lengths: each order is an object on the road of
    its priority, from a meter given by its key, an extent of up to a million
    meters by its total price; each line item is a case on the road of its line
    number (6 and 7 have no objects), at a meter given by its price.  Overlaps are
    the rule, and a case gets the order key of the first (smallest) object over it."""
    from casework.operators import enrich
    t = Tables(spark, sf_dir)
    start = ((F.col("o_orderkey") * 7919) % 1_000_003).cast("double")
    length = F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 50 == 0, F.lit(2.0)).otherwise(F.lit(0.002)))
    objects = t.orders.select(
        F.lit(815).alias("object_type"), F.col("o_orderkey").alias("object_id"), F.col("o_orderkey").alias("ord"),
        F.array(F.struct(F.lit("Key").alias("name"), F.col("o_orderkey").cast("string").alias("value"))).alias("properties"),
        F.array(F.struct(F.concat(F.lit("R"), F.substring("o_orderpriority", 1, 1)).alias("road"), start.alias("meter"),
                         (start + length).alias("meter_to"))).alias("references"))
    meter = F.floor(F.col("l_extendedprice") * 10) % 1_000_003
    road = F.concat(F.lit("R"), (F.col("l_linenumber") % 7).cast("string"))
    cases = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(road, F.lit(" m"), meter.cast("string")).alias("road_ref"))
    return enrich.lookup_by_reference(cases, objects, 815, "Key", "first_order")


def stratified_split_missing(spark, sf_dir):
    """G2 with a stratum that is missing: its rows are split like any other."""
    from casework.operators import sample
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.when(
        F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"))
    return sample.stratified_split(o, "o_orderkey", ["priority"], 0.2, seed=3)


def oversample_missing(spark, sf_dir):
    """G4 with rows that have no label: they stay once."""
    from casework.operators import sample
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.when(
        F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"))
    return sample.oversample(o, "o_orderkey", "status", seed=5)


def label_encode_many(spark, sf_dir):
    """G8 with far more than fifty categories (every customer key as text)."""
    from casework.operators import features
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return features.label_encode(o, ["customer"])


def _orders_by_text(t: Tables) -> DataFrame:
    """Orders under the text ids that the library gives rows."""
    from casework.operators import browse
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return browse.with_row_id(o, _ROW_KEY).withColumn(
        "label", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(clean.REJECT)).otherwise(F.lit(clean.PERMIT)))


def split_text_keys(spark, sf_dir):
    """G1 + G2 on text keys: a hash split and a stratified split by row id."""
    from casework.operators import sample
    o = sample.hash_split(_orders_by_text(Tables(spark, sf_dir)), "row_id", (0.6, 0.4), seed=42, out="part")
    return sample.stratified_split(o, "row_id", ["o_orderstatus"], 0.2, seed=7).select("o_orderkey", "part", "split")


def samples_text_keys(spark, sf_dir):
    """G3, G4 and G6 on text keys: how often each order is drawn by each."""
    from casework.operators import sample
    o = _orders_by_text(Tables(spark, sf_dir)).select("row_id", "o_orderkey", "label")
    drawn = (sample.balanced_sample(o, "row_id", "label", clean.REJECT, 2.0, seed=5).select("o_orderkey", F.lit("sample").alias("way"))
             .unionByName(sample.oversample(o, "row_id", "label", seed=9).select("o_orderkey", F.lit("copies").alias("way")))
             .unionByName(sample.balanced_bags(o, "row_id", "label", clean.REJECT, bags=3, seed=100)
                          .select("o_orderkey", F.concat(F.lit("bag"), F.col("bag")).alias("way"))))
    return drawn.groupBy("o_orderkey", "way").agg(F.count(F.lit(1)).alias("n"))


def _files(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid
    from casework.session import scratch_dir
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark, sf_dir):
    """The documents as a case file (texts with line breaks,
    quotes and separators; strings quoted), written and read again."""
    from casework.sources import cases as files
    d = Tables(spark, sf_dir).documents
    rows = d.select(F.col("doc_id").alias("case_id"), F.col("text").alias("extra_info"), F.col("lang").alias("purpose"),
                    (F.col("n_chars") / 4).alias("aadt_total"), F.concat(F.lit('a;"b" '), F.col("source")).alias("policy_class"))
    out = []
    for quoted in (False, True):
        path = _files(spark, "cases")
        files.write_cases(rows, path, quote_strings=quoted)
        out.append(files.read_cases(spark, path).select(
            "case_id", F.lit(quoted).alias("quoted"), F.md5("extra_info").alias("text_md5"), "purpose", "aadt_total", "policy_class"))
    return out[0].unionByName(out[1])


def csv_bad_rows(spark, sf_dir):
    """A1 + A3: customer lines with a cell too few (nation 3) or too many
    (nation 5) are reported with their reason; the rest is read."""
    from casework.sources import cases as files
    c = Tables(spark, sf_dir).customer
    cells = [F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")]
    line = (F.when(F.col("c_nationkey") == 3, F.concat_ws(";", *cells[:2])).when(F.col("c_nationkey") == 5, F.concat_ws(";", *cells, F.lit('"x;y"')))
            .otherwise(F.concat_ws(";", *cells)))
    path = _files(spark, "lines")
    c.select(line.alias("OBJ.VEGOBJEKT-ID; EGS.VEDTAK.10670 ;nation")).write.option("header", True).option(
        "quote", "\u0000").option("sep", "\u0001").csv(path)
    rows = files.scan(spark, path)
    bad = files.bad_rows(rows).select(F.split("record", ";")[0].cast("long").alias("case_id"), "reason")
    good = files.read_cases(spark, path).select("case_id", "decision", F.col("nation").cast("double").alias("nation"))
    return good.join(bad, "case_id", "full").select("case_id", "decision", "nation", "reason")


def object_snapshot(spark, sf_dir):
    """A12 + C5: parts as road objects (JSON lines with one or two references,
    some without a meter), written and read again; points of each road within
    500 m of a supplier's place are counted."""
    from casework.operators import enrich
    from casework.sources import cases as files
    t = Tables(spark, sf_dir)
    road = F.concat(F.lit("B"), F.substring("p_brand", -1, 1))
    meter = F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice"))
    first = F.struct(road.alias("road"), meter.alias("meter"))
    second = F.struct(F.lit("B0").alias("road"), (F.col("p_size") * 20).cast("double").alias("meter"))
    objects = t.part.select(
        F.when(F.col("p_size") % 2 == 0, 46).otherwise(570).alias("object_type"), F.col("p_partkey").alias("object_id"),
        F.col("p_partkey").alias("ord"), F.array(F.struct(F.lit("Klasse").alias("name"), F.col("p_type").alias("value"))).alias("properties"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("references"))
    path = _files(spark, "objects")
    objects.write.json(path)
    points = enrich.object_points(files.read_road_objects(spark, path), 46)
    place = (F.col("s_suppkey") * 7 % 1500).cast("double")
    sup = t.supplier.select("s_suppkey", F.concat(F.lit("B"), (F.col("s_suppkey") % 6).cast("string"), F.lit(" m"), place.cast("string")).alias("road_ref"))
    return enrich.count_within_ref(sup, points, "road_ref", 500.0, out="n_objects").select("s_suppkey", "n_objects")


def stat_sinks(spark, sf_dir):
    """Value counts of two columns stored as partitioned statistic tables and read again."""
    from casework.sources import cases as files
    o = Tables(spark, sf_dir).orders
    path = _files(spark, "stats")
    for col in ("o_orderstatus", "o_orderpriority"):
        counts = profile.value_counts(o, col).select(F.lit(col).alias("column_name"), F.col(col).alias("value"), "n")
        files.write_stats(counts, path, f"counts_{col}", partition=["column_name"])
    tables = [spark.read.parquet(f"{path}/counts_{c}") for c in ("o_orderstatus", "o_orderpriority")]
    return tables[0].unionByName(tables[1]).select("stat_table", F.col("column_name").cast("string").alias("column_name"), "value", "n")


def threshold_store(spark, sf_dir):
    """The class thresholds of E7, stored and read again; a class without one keeps NULL."""
    from casework.sources import cases as files
    path = _files(spark, "thresholds")
    files.write_thresholds(class_thresholds(spark, sf_dir).select(
        F.lit(2).alias("stage"), "class", "threshold", F.lit(0.95).alias("target_precision")), path)
    return files.read_thresholds(spark, path)


def source_headers(spark, sf_dir):
    """B2 + B3: line items under source headers with blanks around them, the
    radius under its other header, counts and numbers as text; absent columns
    come as NULL and a cell that is no number too."""
    from casework.sources import cases as files
    li = Tables(spark, sf_dir).lineitem
    raw = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"),
        F.col("l_orderkey").cast("string").alias(" OBJ.VEGOBJEKT-ID "),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))).alias("ÅDT, total "),
        F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(".0")).alias("Avkjørsler"),
        F.col("l_quantity").cast("string").alias("\tKurvatur, horisontalelement"))
    typed = files.conform(files.to_snake(files.clean_names(raw)))
    return typed.select("key", "case_id", "aadt_total", "accesses", "curve_radius", "accidents", "municipality")


def ordered_columns(spark, sf_dir):
    """Customers with the columns named first in front, absent names passed
    over; the names in their order stand in a column, for the compare sorts columns."""
    from casework.sources import cases as files
    c = Tables(spark, sf_dir).customer
    out = files.export_ordered(c, ["c_mktsegment", "nowhere", "c_custkey", "c_mktsegment"])
    return out.withColumn("order", F.lit(",".join(out.columns)))


def argmax_class(spark, sf_dir):
    """E5: the order status that most of a customer's orders have, with its share;
    the shares by status stand for class probabilities, ties go to the first class."""
    from casework.operators import evaluate
    classes = ["F", "O", "P"]
    o = Tables(spark, sf_dir).orders
    n = o.groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == c).alias(c) for c in classes], F.count(F.lit(1)).alias("n"))
    cls, conf = evaluate.argmax_class(F.array(*[F.col(c) / F.col("n") for c in classes]), classes)
    return n.select("o_custkey", cls.alias("pred_class"), F.round(conf, 9).alias("confidence"))


def _registry() -> dict:
    names = [
        "outcome_crosstab_pct", "freq_by_outcome", "profile_numeric", "profile_mixed",
        "profile_by_confusion", "confusion_subset_counts", "cardinality_gate", "encode_gate", "corr_matrix",
        "top_mean_diff", "score_quantiles", "box_stats", "kde_grid", "histogram_density",
        "facet_options", "facet_bounds",
        "confusion", "class_report", "auto_approve", "high_conf_report", "class_ratio",
        "precision_threshold", "class_thresholds", "grid_threshold", "two_stage_policy",
        "two_stage_metrics", "gated_policy", "rule_reject",
        "merge_annotations", "unmatched_keys", "duplicate_keys", "reconcile",
        "lookup_attribute", "lookup_first_line", "count_within", "count_events_nearby",
        "clean_parse_numbers", "curve_category", "curve_category_counts", "risk_band",
        "derived_features", "facet_filter", "row_lookup", "row_ids",
        "hash_split", "stratified_split", "nested_split", "balanced_sample", "oversample",
        "balanced_bags", "stage2_pool", "one_hot", "one_hot_unseen", "label_encode", "zscore",
        "interactions3", "impute_stats", "impute", "similar_cases", "reject_examples",
        "case_text", "prompt", "parse_reply", "explanation_text", "application_type",
        "sparse_prune", "quality_report", "similar_embeddings",
        "annotated_counts", "reject_rate", "count_within_ref",
        "lookup_by_reference", "lookup_along_road", "duplicate_annotations", "row_ids_repeated",
        "stratified_split_missing", "oversample_missing", "label_encode_many",
        "split_text_keys", "samples_text_keys", "csv_round_trip", "csv_bad_rows", "argmax_class",
        "similar_cases_default", "similar_embeddings_default", "object_snapshot", "stat_sinks", "threshold_store",
        "source_headers", "ordered_columns",
    ]
    g = globals()
    return {n: g[n] for n in names}


QUERIES = _registry()


def _add_model_queries():
    from casework.plans.jobs import MODEL_QUERIES
    QUERIES.update(MODEL_QUERIES)


_add_model_queries()
