"""Models, scoring and explanations (G5, H1-H8) on ``pyspark.ml``.

* Forests and boosted trees are the ``pyspark.ml`` learners as they are;
  class balance comes from a weight column (n / (k * n_class)) or from the
  sampling operators (G4 oversampling, G5 ADASYN, G6 bags).
* Tree contributions (H7) come from the model's own node table (the saved
  model is Parquet of nodes) and ``leafCol`` (the leaf each row reaches in each
  tree): per-leaf contributions are derived once per tree with
  ``applyInPandas`` (one small group per tree).  Up to a checked size they go
  to the workers, which add a batch's leaf vectors where the rows lie
  (``forests.row_contributions``); beyond it rows join them on (tree, leaf).
* Models are loaded once per job and applied with ``transform``.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from casework.functions.derive import risk_band
from casework.operators import features as feat_ops
from casework.operators import forests, sample
from casework.operators.similar import global_segment, knn
from casework.session import checkpoint_dir, materialize


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_class); the per-class table is tiny (broadcast)."""
    cnt = df.groupBy(_q(label)).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = df.select(F.count_distinct(_q(label))).scalar()
    w = cnt.select(_q(label), (n / (k * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), [label])


def forest_pipeline(features: list[str], label: str, trees: int = 50, depth: int = 8,
                    weight: str | None = None, seed: int = 42, leaf: bool = False) -> Pipeline:
    """H1/H2/H3: assembler + random forest (depth set explicitly)."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                                seed=seed, featureSubsetStrategy="auto")
    if weight:
        rf.setWeightCol(weight)
    if leaf:
        rf.setLeafCol("leaf")
    return Pipeline(stages=[va, rf])


def preprocess_stages(num_cols: list[str], cat_cols: list[str], out: str = "features") -> list:
    """Category columns -> StringIndexer (unseen kept as an extra index) ->
    OneHotEncoder (dropLast, so unseen/missing encode as all zeros) -> one
    vector with the numeric columns.  Numeric fills come from
    ``features.impute`` (exact medians) before the pipeline."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = [f"{c}__idx" for c in cat_cols]
    vec = [f"{c}__vec" for c in cat_cols]
    stages = []
    if cat_cols:
        stages.append(StringIndexer(inputCols=cat_cols, outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the indexer's extra "unseen" index is the last category, which dropLast removes
        stages.append(OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True))
    stages.append(VectorAssembler(inputCols=num_cols + vec, outputCol=out, handleInvalid="keep"))
    return stages


def preprocessed_forest(num_cols: list[str], cat_cols: list[str], label: str, trees: int = 50,
                        depth: int = 8, weight: str | None = None, seed: int = 42) -> Pipeline:
    """H2/H3 with G11 preprocessing (the two-stage models' input pipeline)."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                                seed=seed)
    if weight:
        rf.setWeightCol(weight)
    return Pipeline(stages=preprocess_stages(num_cols, cat_cols) + [rf])


def gbt_pipeline(features: list[str], label: str, rounds: int = 600, depth: int = 5,
                 step: float = 0.05, subsample: float = 0.9, columns: float = 0.9, weight: str | None = None,
                 seed: int = 42) -> Pipeline:
    """H4: boosted trees with the difficulty model's settings; each split sees
    ``columns`` of the inputs."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth,
                        stepSize=step, subsamplingRate=subsample, seed=seed, featureSubsetStrategy=str(columns))
    if weight:
        gbt.setWeightCol(weight)
    return Pipeline(stages=[va, gbt])


def importances(model: PipelineModel, features: list[str], k: int | None = None) -> DataFrame:
    """Ranked importance table (feature, importance, rank).  The
    vector has one entry per feature: bounded by the model, not the data."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda r: (-r[1], r[0]))
    if k:
        rows = rows[:k]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def p_positive(df: DataFrame, prob_col: str = "probability", index: int = 1) -> Column:
    return vector_to_array(F.col(prob_col))[index]


def score_reject(model: PipelineModel, df: DataFrame) -> DataFrame:
    """H5: probability of rejection, percent (1 decimal), and the band of the
    probability itself (not of the rounded percent)."""
    out = model.transform(df)
    p = p_positive(out)
    return out.withColumn("p_reject", p).withColumn("percent", F.round(p * 100, 1)) \
              .withColumn("band", risk_band(F.col("p_reject"))) \
              .drop("features", "rawPrediction", "probability")


def score_difficulty(model: PipelineModel, df: DataFrame, inputs: list[str], threshold: float,
                     hard: str = "Vanskelig", easy: str = "Enkel") -> DataFrame:
    """H6: absent inputs default to 0.0; p >= threshold -> hard."""
    filled = df.fillna(0.0, subset=inputs)
    out = model.transform(filled)
    p = p_positive(out)
    return out.withColumn("p_difficult", p).withColumn(
        "difficulty_pred", F.when(p >= threshold, F.lit(hard)).otherwise(F.lit(easy))) \
        .drop("features", "rawPrediction", "probability", "prediction")


def adasyn(df: DataFrame, id_col: str, feats: list[str], label: str, minority=1,
           k: int = 5, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """ADASYN synthesis up to ``ratio`` minority/majority.

    Difficulty r_i = share of majority rows among the k nearest neighbours of
    minority row i (all rows); quota g_i = rint(r_i / sum r * G) with
    G = ratio * n_maj - n_min; each synthetic row interpolates towards one of
    the k nearest minority neighbours with a hash-driven lambda in [0, 1).
    Neighbour search is the exact ``knn`` on tiles.  Output: synthetic rows
    (id, feats..., label) with unique ids: negative ones, or ``id#i`` where ids are texts."""
    base = df.select(_q(id_col).alias("_id"), *[_q(f).cast("double").alias(f) for f in feats],
                     _q(label).alias("_y"))
    base = materialize(base)   # read by both searches
    mino = base.where(F.col("_y") == F.lit(minority))
    counts = base.agg(F.count_if(F.col("_y") == F.lit(minority)).alias("n_min"),
                      F.count_if(F.col("_y") != F.lit(minority)).alias("n_maj"))
    qs = mino.select(F.col("_id").alias("qid"), global_segment("_id").alias("seg"),
                     *[F.col(f).alias("q_" + f) for f in feats])
    allp = base.select(F.col("_id").alias("nid"), global_segment("_id").alias("seg"),
                       *[F.col(f).alias("p_" + f) for f in feats])
    nn_all = knn(qs, allp, feats, k)
    lab = base.select(F.col("_id").alias("nid"), F.col("_y").alias("_ny"))
    r = nn_all.join(lab, "nid").groupBy("qid").agg(
        (F.count_if(F.col("_ny") != F.lit(minority)) / F.lit(float(k))).alias("r"))
    r = materialize(r)
    g = r.withColumn("rs", r.select(F.sum("r")).scalar()) \
         .withColumn("n_min", counts.select("n_min").scalar()) \
         .withColumn("n_maj", counts.select("n_maj").scalar()).withColumn(
        "gi", F.when(F.col("rs") > 0, F.rint(F.col("r") / F.col("rs") *
                                            F.greatest(F.floor(F.col("n_maj") * ratio) - F.col("n_min"),
                                                       F.lit(0)))).otherwise(F.lit(0)).cast("long"))
    g = g.where(F.col("gi") > 0).select("qid", "gi")
    pm = mino.select(F.col("_id").alias("nid"), global_segment("_id").alias("seg"),
                     *[F.col(f).alias("p_" + f) for f in feats])
    nn_min = materialize(knn(qs, pm, feats, k))
    reps = g.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("gi"))).alias("j"))
    number = sample.key_number("qid") % sample.HASH_MOD
    pick = F.pmod(sample.hash_bucket(number * 7919 + F.col("j"), seed), F.lit(k)) + 1
    reps = reps.withColumn("rank", pick.cast("int"))
    lam = sample.hash_bucket(number * 104729 + F.col("j"), seed + 1) / F.lit(float(sample.HASH_MOD))
    # ids below zero, one block of them for each source row
    block = g.select(F.max("gi") + 1).scalar()
    j = reps.withColumn("_block", block).join(nn_min.select("qid", "nid", "rank"), ["qid", "rank"]) \
            .join(mino.select(F.col("_id").alias("qid"), *[F.col(f).alias("x_" + f) for f in feats]), "qid") \
            .join(mino.select(F.col("_id").alias("nid"), *[F.col(f).alias("z_" + f) for f in feats]), "nid")
    is_text = isinstance(df.schema[id_col].dataType, StringType)
    new_id = F.concat_ws("#", "qid", "j") if is_text else -(F.col("qid") * F.col("_block") + F.col("j"))
    out = j.select(new_id.alias(id_col),
                   *[(F.col("x_" + f) + lam * (F.col("z_" + f) - F.col("x_" + f))).alias(f) for f in feats],
                   F.lit(minority).alias(label))
    return out


def reject_inputs(df: DataFrame, keep: list[str], numeric: list[str], classes: dict[str, list[str]] | None = None,
                  derived: dict[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """The raw inputs of the reject model and their names: numbers, derived
    numbers (bends, hills, long vehicles: B21) and an indicator for every class
    of the text columns.  Missing numbers count as 0, missing and unseen classes as none."""
    classes, derived = classes or {}, derived or {}
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    cols = [number(_q(c)).alias(c) for c in numeric] + [number(e).alias(n) for n, e in derived.items()]
    cols += [F.coalesce((_q(c).cast("string") == F.lit(x)).cast("double"), F.lit(0.0)).alias(f"{c}_{x}") for c, xs in classes.items() for x in xs]
    names = [*numeric, *derived, *[f"{c}_{x}" for c, xs in classes.items() for x in xs]]
    return df.select(*[_q(k) for k in keep], *cols), names


def fit_reject_model(df: DataFrame, id_col: str, inputs: list[str], label: str,
                     screen_trees: int = 50, final_trees: int = 100, depth: int = 8, top: int = 10,
                     test_frac: float = 0.4, seed: int = 43, class_cols: list[str] | None = None,
                     derived: dict[str, Column] | None = None, bags: int = 5) -> dict:
    """H1: split first; screen all 1-3-way interactions of the raw inputs (with
    class indicators of ``class_cols`` and ``derived`` numbers) by a forest on
    ``bags`` balanced bags of the training part (two majority rows for each
    minority row); keep the top ``top`` by importance, add minority rows with
    ADASYN (ratio 0.5) and fit the final forest on bags with as many majority as
    minority rows.  Every bag is a learner call of its own (``forests.fit_bags``).
    Returns {model, inputs, classes, derived, features, names, test,
    importances, bags}; ``serve_reject`` scores raw cases with it."""
    classes = {c: feat_ops.vocabulary(df, c) for c in class_cols or []}
    raw, raw_names = reject_inputs(df, [id_col, label], inputs, classes, derived)
    terms, members = zip(*feat_ops.interaction_names(raw_names, 3), strict=True)
    # the raw inputs are held; their products are made where they are read
    split = materialize(sample.hash_split(raw, id_col, (1 - test_frac, test_frac), seed=seed))
    train = split.where(F.col("split") == "train").drop("split")
    drawn = sample.balanced_bags(train, id_col, label, 1.0, bags=bags, ratio=2.0, seed=seed)
    screen = forests.fit_bags(drawn, raw_names, label, bags, max(1, screen_trees // bags), depth, seed=seed,
                              vectors=lambda bag: feat_ops.interaction_vectors(bag, raw_names, 3, keep=[label]))
    safe = [f"x{i}" for i in range(len(terms))]
    imp = importances(screen, safe, top)
    keep = [r["feature"] for r in imp.collect()]  # top-k names: bounded by ``top``
    chosen = [feat_ops.product(members[int(c[1:])]).alias(c) for c in keep]
    train, test = (split.where(F.col("split") == part).select(_q(id_col), _q(label), *chosen) for part in ("train", "test"))
    syn = materialize(adasyn(train, id_col, keep, label, 1.0, 5, 0.5, seed).select(id_col, label, *keep))
    aug = train.unionByName(syn)
    even = sample.balanced_bags(aug, id_col, label, 1.0, bags=bags, ratio=1.0, seed=seed + 1)
    model = forests.fit_bags(even, keep, label, bags, max(1, final_trees // bags), depth, seed=seed)
    back = dict(zip(safe, terms, strict=True))
    return {"model": model, "inputs": inputs, "classes": classes, "derived": derived, "features": keep, "names": [back[c] for c in keep],
            "test": test, "importances": imp, "bags": even}


def serve_reject(fit: dict, cases: DataFrame, id_col: str) -> DataFrame:
    """H5 for raw cases: the same inputs and interactions as in the fit, then
    probability, percent and band."""
    raw, names = reject_inputs(cases, [id_col], fit["inputs"], fit["classes"], fit["derived"])
    inter = feat_ops.interactions(raw, names, 3, keep=[id_col])
    x = inter.select(_q(id_col), *[_q(n).alias(f) for f, n in zip(fit["features"], fit["names"], strict=True)])
    return score_reject(fit["model"], x).select(_q(id_col), "p_reject", "percent", "band")


# ------------------------------------------------------------- contributions

def _tree_table(model_stage) -> DataFrame:
    """Node table of a fitted tree ensemble, read back from its saved form
    (written under the session's checkpoint folder)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    d = checkpoint_dir(spark)
    if not d:
        materialize(spark.range(1))  # sets up the local scratch folder when none is named
        d = checkpoint_dir(spark)
    path = f"{d.rstrip('/')}/model-{uuid.uuid4().hex}"
    model_stage.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data")


def leaf_contributions(nodes: DataFrame, class_index: int = 1) -> DataFrame:
    """Per tree and leaf: the change of the class share at every split on the
    way from the root, attributed to the split's feature, plus the root
    share (bias).  Output (treeID, leaf, feature, contribution) with
    feature = -1 carrying the bias.  One ``applyInPandas`` group per tree."""
    flat = nodes.select("treeID", F.col("nodeData.id").alias("id"),
                        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                        F.col("nodeData.impurityStats").alias("stats"),
                        F.col("nodeData.split.featureIndex").alias("feature"))

    def per_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes_ = {int(r.id): r for r in pdf.itertuples(index=False)}

        def value(n):
            s = list(n.stats)
            tot = float(sum(s))
            return float(s[class_index]) / tot if tot > 0 else 0.0
        out = []
        leaves = sorted(i for i, n in nodes_.items() if n.left < 0)
        ordinal = {nid: i for i, nid in enumerate(leaves)}
        tid = int(pdf["treeID"].iloc[0])
        stack = [(0, {})]
        root_v = value(nodes_[0])
        while stack:
            nid, acc = stack.pop()
            n = nodes_[nid]
            if n.left < 0:
                out.append((tid, ordinal[nid], -1, root_v))
                for f, c in acc.items():
                    out.append((tid, ordinal[nid], int(f), c))
                continue
            v = value(n)
            for child in (int(n.left), int(n.right)):
                a = dict(acc)
                a[int(n.feature)] = a.get(int(n.feature), 0.0) + value(nodes_[child]) - v
                stack.append((child, a))
        return pd.DataFrame(out, columns=["treeID", "leaf", "feature", "contribution"])

    return flat.groupBy("treeID").applyInPandas(
        per_tree, "treeID int, leaf int, feature int, contribution double")


def forest_contributions(model: PipelineModel, df: DataFrame, id_col: str,
                         features: list[str]) -> DataFrame:
    """H7: per row and feature the averaged path contribution; feature
    ``bias`` holds the averaged root share.  bias + sum = probability.
    ``model`` must be a forest pipeline fitted with ``leaf=True``."""
    rf = model.stages[-1]
    n_trees = rf.getNumTrees
    lc = materialize(leaf_contributions(_tree_table(rf)))
    scored = model.transform(df)
    width = lc.agg(F.count_distinct("treeID", "leaf")).first()[0] * (len(features) + 1) * 9
    if width <= forests.LEAF_TABLE_BYTES:
        return forests.row_contributions(scored, lc, n_trees, features, id_col)
    # a forest too large for every worker: rows meet its leaves in a join
    ex = (scored.select(_q(id_col).alias("_rid"), F.posexplode(vector_to_array("leaf")).alias("treeID", "leaf"))
          .select("_rid", F.col("treeID").cast("int"), F.col("leaf").cast("int")))
    names = F.array(*[F.lit(f) for f in features])
    agg = ex.join(lc, ["treeID", "leaf"]).groupBy("_rid", "feature").agg((F.sum("contribution") / F.lit(float(n_trees))).alias("contribution"))
    return agg.select(F.col("_rid").alias(id_col),
                      F.when(F.col("feature") < 0, F.lit("bias"))
                      .otherwise(F.element_at(names, F.col("feature") + 1)).alias("feature"),
                      "contribution")
