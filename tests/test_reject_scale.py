"""What the reject model and the forests on bags hold and read does not grow with products, tiles or bags."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casework.operators import features, forests, models, sample, similar


def _cases(spark, n=600):
    rows = [(i, float(i % 97), float(i * 7 % 31), "ab"[i % 2], float(i % 97 > 70)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double")


def test_products_are_never_held(spark, monkeypatch):
    held = []
    for module in (models, sample, forests, similar):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", lambda df, f=module.materialize: held.append(df.schema) or f(df))
    fit = models.fit_reject_model(_cases(spark), "id", ["a", "b"], "y", 2, 2, depth=2, top=3, class_cols=["c"], bags=2)
    assert len(fit["features"]) == 3 and held
    assert not any(f.dataType.typeName() in ("array", "vectorudt") and f.name in ("interactions", "features") for s in held for f in s.fields)


def test_product_vectors_are_the_interactions(spark):
    df = _cases(spark, 50).select("id", "a", "b", F.col("y").alias("c"))
    want = {r.id: r.interactions for r in features.interactions(df, ["a", "b", "c"], 3, keep=["id"], as_array=True).collect()}
    whole = spark.conf.get("spark.sql.codegen.wholeStage")
    got = {r.id: r.v for r in features.interaction_vectors(df, ["a", "b", "c"], 3, keep=["id"]).select("id", vector_to_array("features").alias("v")).collect()}
    assert got == want and spark.conf.get("spark.sql.codegen.wholeStage") == whole


def test_a_bag_reads_its_own_files_and_they_go(spark):
    rows = _cases(spark).withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(3))))
    with forests.stored_bags(rows) as ready:
        one = ready.where("bag = 2")
        files = [r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()]
        assert one.count() == 600 and files and all("/bag=2/" in f for f in files) and sorted(one.columns) == sorted(rows.columns)
        assert "PartitionFilters: [isnotnull(bag" in one._jdf.queryExecution().executedPlan().toString()
        path = ready.inputFiles()[0].split("/bag=")[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_boxes_give_all_near_tiles_and_pass_over_the_rest():
    rng = np.random.default_rng(3)
    cuts = similar.Tiles()
    x = rng.normal(size=(4000, 3))
    root = cuts.grow(x, 20)
    tile = cuts.of(np.full(len(x), root), x)
    full = tile != tile[0]          # one tile without points
    used = np.unique(tile[full])
    lo, hi = (np.array([f(x[full & (tile == t)], axis=0) for t in used]) for f in (np.min, np.max))
    boxes = similar.Boxes(cuts, used, lo, hi)
    q = rng.normal(size=(200, 3))
    bound = np.where(np.arange(200) == 5, np.inf, 0.02)
    got = {(int(r), int(t)) for rows, tiles in boxes.within(np.full(200, root), q, bound) for r, t in zip(rows, tiles, strict=True)}
    d = (np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0) ** 2).sum(axis=2)
    assert got == {(i, int(used[j])) for i, j in zip(*np.nonzero(d <= bound[:, None]), strict=True)}
    # boxes looked at, for all but the unbounded row
    looked, lows = [0], boxes.lo

    class Counted(np.ndarray):
        def __getitem__(self, key):
            looked[0] += len(key[0])
            return np.asarray(super().__getitem__(key))
    boxes.lo = lows.view(Counted)
    list(boxes.within(np.full(200, root), q, np.full(200, 0.02)))
    assert looked[0] / 3 < 200 * len(used) / 4
