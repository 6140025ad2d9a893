"""Sources and sinks: delimited scans with source headers, conform, stores."""

import os
import tempfile

from pyspark.sql import functions as F

from casework.operators import enrich
from casework.sources import cases as C


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_cases_conform_and_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="cw-src-")
    src = os.path.join(d, "in.csv")
    hdr = ";".join([" OBJ.VEGOBJEKT-ID ", "EGS.VEDTAK.10670", "ÅDT, total", "Kurvatur, horisontalelement",
                    "Avkjørsler", "VSR.VEGSYSTEMREFERANSE"])
    _write(src, hdr + "\n1;Avslag;1400;99999;25;FV6798 S1D1 m2717\n2;;abc;-600;;EV6 S1D1 m10 K1\n")
    df = C.read_cases(spark, src)
    r = df.orderBy("case_id").collect()
    assert [x.case_id for x in r] == [1, 2]
    assert r[0].aadt_total == 1400.0 and r[1].aadt_total is None          # bad number -> NULL
    assert r[0].curve_radius == 99999.0 and r[1].accesses is None          # alternate header
    assert r[0].decision == "Avslag" and r[1].municipality is None         # absent column -> NULL
    out = os.path.join(d, "out")
    C.write_cases(df.select("case_id", "decision", "road_ref"), out, sep=";", quote_strings=True)
    back = spark.read.option("header", True).option("sep", ";").csv(out)
    assert "OBJ.VEGOBJEKT-ID" in back.columns and back.count() == 2
    ordered = C.export_ordered(df, ["road_ref", "case_id", "missing_col", "case_id"])
    assert ordered.columns[:2] == ["road_ref", "case_id"]


def test_threshold_store_and_runs(spark):
    d = tempfile.mkdtemp(prefix="cw-thr-")
    t = spark.createDataFrame([(1, "Avslag", 0.8, 0.99), (2, "Utvidet bruk", None, 0.99)], C.THRESHOLD_SCHEMA)
    C.write_thresholds(t, os.path.join(d, "thr"))
    back = C.read_thresholds(spark, os.path.join(d, "thr")).orderBy("stage").collect()
    assert back[0].threshold == 0.8 and back[1].threshold is None
    C.append_run(spark, os.path.join(d, "runs"), "r1", {"accuracy": 0.9})
    C.append_run(spark, os.path.join(d, "runs"), "r2", {"accuracy": 0.8})
    assert spark.read.parquet(os.path.join(d, "runs")).count() == 2


def test_road_object_lookup_and_counts(spark):
    d = tempfile.mkdtemp(prefix="cw-obj-")
    objs = os.path.join(d, "obj.json")
    lines = [
        '{"object_type": 540, "object_id": 1, "ord": 2, "properties": [{"name": "ÅDT, total", "value": "900"}], '
        '"references": [{"road": "FV1 S1D1", "meter": 100.0}]}',
        '{"object_type": 540, "object_id": 2, "ord": 1, "properties": [{"name": "ÅDT, total", "value": "700"}, '
        '{"name": "ÅDT, total", "value": "800"}], "references": [{"road": "FV1 S1D1", "meter": 200.0}]}',
        '{"object_type": 540, "object_id": 3, "ord": 3, "properties": [], "references": [{"road": "FV2 S1D1", "meter": 5.0}]}',
        '{"object_type": 46, "object_id": 4, "ord": 1, "properties": [], '
        '"references": [{"road": "FV1 S1D1", "meter": 600.0}, {"road": "FV1 S1D1", "meter": 601.0}]}',
        '{"object_type": 46, "object_id": 5, "ord": 2, "properties": [], "references": [{"road": "FV1 S1D1", "meter": 1101.0}]}',
        '{"object_type": 46, "object_id": 6, "ord": 3, "properties": [], "references": [{"road": "FV1 S1D1", "meter": null}]}',
    ]
    _write(objs, "\n".join(lines) + "\n")
    o = C.read_road_objects(spark, objs)
    cases = spark.createDataFrame([(1, "FV1 S1D1 m100"), (2, "FV2 S1D1 m5 K2"), (3, "FV9 S1D1 m1")],
                                  "case_id long, road_ref string")
    got = {r.case_id: r.aadt for r in enrich.lookup_by_reference(cases, o, 540, "ÅDT, total", "aadt").collect()}
    assert got == {1: "900", 2: "", 3: ""}  # the object at m100, not the road's first one
    pts = enrich.object_points(o, 46)
    cnt = {r.case_id: r.n for r in enrich.count_within_ref(
        spark.createDataFrame([(1, "FV1 S1D1 m101"), (2, "FV1 S1D1 m601 K1"), (3, "FV1 S1D1")],
                              "case_id long, road_ref string"), pts, out="n").collect()}
    assert cnt == {1: 2, 2: 3, 3: 0}


def test_write_stats_partitioned(spark):
    d = tempfile.mkdtemp(prefix="cw-stats-")
    df = spark.createDataFrame([("a", "mean", 1.0), ("b", "mean", 2.0)], "column_name string, stat string, v double")
    C.write_stats(df, d, "describe", partition=["stat"])
    back = spark.read.parquet(os.path.join(d, "describe"))
    assert back.count() == 2 and "stat" in back.columns


def test_preprocess_unseen_category(spark):
    from casework.operators import features, models
    train = spark.createDataFrame([(1.0, "A", 0.0), (None, "B", 1.0), (3.0, "A", 1.0)], "x double, c string, y double")
    test = spark.createDataFrame([(2.0, "Z", 0.0), (2.0, None, 0.0)], train.schema)
    stats = features.impute_stats(train, ["x"], ["c"])
    tr = features.impute(train, ["x"], ["c"], stats)
    te = features.impute(test, ["x"], ["c"], stats)
    from pyspark.ml import Pipeline
    pm = Pipeline(stages=models.preprocess_stages(["x"], ["c"])).fit(tr)
    vecs = [r.features.toArray().tolist() for r in pm.transform(te).collect()]
    assert vecs[0] == [2.0, 0.0, 0.0]          # unseen -> all zeros
    assert vecs[1] == [2.0, 1.0, 0.0]          # missing -> most frequent 'A'
    assert [r.x for r in tr.collect()][1] == 2.0  # exact median fill


def test_readme_quick_start(spark):
    """The README quick start runs end to end on a three-case fixture."""
    from casework.functions import clean
    from casework.operators import features, profile, similar
    d = tempfile.mkdtemp(prefix="cw-quick-")
    _write(os.path.join(d, "cases.csv"),
           "OBJ.VEGOBJEKT-ID;EGS.VEDTAK.10670;EGS.BRUKSOMRÅDE.1256;Avkjørsel, holdningsklasse;ÅDT, total;"
           "ÅDT, andel lange kjøretøy;Fartsgrense;Trafikkulykker;VSR.VEGSYSTEMREFERANSE\n"
           "1;Avslag;Bolig;Lite streng;1400;9;30;1;FV1 S1D1 m100\n"
           "2;Varig tillatelse;Bolig;Lite streng;900;5;50;0;FV1 S1D1 m700\n"
           "3;Varig tillatelse;Bolig;Lite streng;1000;6;60;2;FV1 S1D1 m300\n")
    _write(os.path.join(d, "objects.json"),
           '{"object_type": 46, "object_id": 1, "ord": 1, "properties": [], '
           '"references": [{"road": "FV1 S1D1", "meter": 400.0}]}\n'
           '{"object_type": 540, "object_id": 2, "ord": 1, "properties": [{"name": "ÅDT, total", "value": "1500"}], '
           '"references": [{"road": "FV1 S1D1", "meter": 0.0, "meter_to": 1000.0}]}\n')
    cases = C.read_cases(spark, os.path.join(d, "cases.csv"))
    cases = cases.withColumn("outcome", clean.binary_outcome("decision"))
    objs = C.read_road_objects(spark, os.path.join(d, "objects.json"))
    cases = enrich.count_within_ref(cases, enrich.object_points(objs, 46), out="accesses_500m")
    cases = enrich.lookup_by_reference(cases, objs, 540, "ÅDT, total", "aadt_text")
    ct = profile.crosstab_pct(cases, ["purpose", "policy_class"], "outcome")
    feats = ["aadt_total", "long_share", "speed_limit", "accidents"]
    z = features.zscore(cases, feats, suffix="")
    ex = similar.similar_cases(z, "case_id", "outcome", "Godkjent", "policy_class", "purpose", feats, k=1)
    assert [(r.accesses_500m, r.aadt_text) for r in cases.orderBy("case_id").collect()] == [(1, "1500")] * 3
    assert ct.count() == 4
    assert {r.case_id: r.example_id for r in ex.collect()} == {1: 3, 2: 3, 3: 2}


ODD = [(1, "a\nb;c", 1.5), (2, 'said "no"; then left', 2.0), (3, None, None), (4, " kept \r\n blank ", 0.25)]


def _frame():
    import pandas as pd
    return pd.DataFrame({"OBJ.VEGOBJEKT-ID": [r[0] for r in ODD], "EGS.TILLEGGSINFORMASJON.11566": [r[1] for r in ODD],
                         "ÅDT, total": [r[2] for r in ODD]})


def test_files_written_by_pandas_are_read(spark, tmp_path):
    import csv
    _frame().to_csv(tmp_path / "a.csv", sep=";", index=False)
    _frame().to_csv(tmp_path / "b.csv", sep=";", index=False, quoting=csv.QUOTE_NONNUMERIC)
    got = C.read_cases(spark, str(tmp_path)).select("case_id", "extra_info", "aadt_total").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(ODD + ODD, key=lambda r: r[0])


def test_pandas_reads_what_is_written(spark, tmp_path):
    import pandas as pd
    df = spark.createDataFrame(ODD, "case_id long, extra_info string, aadt_total double").coalesce(1)
    for quoted in (False, True):
        path = tmp_path / str(quoted)
        C.write_cases(df, str(path), quote_strings=quoted)
        part = next(path.glob("part*"))
        back = pd.read_csv(part, sep=";")
        assert back.astype(object).where(back.notna(), None).values.tolist() == [list(r) for r in ODD]
        line = part.read_text().splitlines()[0]
        assert line == ('"OBJ.VEGOBJEKT-ID";"EGS.TILLEGGSINFORMASJON.11566";"ÅDT, total"' if quoted
                        else "OBJ.VEGOBJEKT-ID;EGS.TILLEGGSINFORMASJON.11566;ÅDT, total")
        assert sorted(map(tuple, C.read_cases(spark, str(path)).select("case_id", "extra_info", "aadt_total").collect())) == ODD


def test_rows_that_do_not_match_the_header_are_reported(spark, tmp_path):
    (tmp_path / "c.csv").write_text('OBJ.VEGOBJEKT-ID;EGS.TILLEGGSINFORMASJON.11566;ÅDT, total\n7;short\n8;too;1,5;cells\n9;"fine;""x""";2\n10;"open;k\n')
    rows = C.scan(spark, str(tmp_path))
    bad = {(r.file.rsplit("/", 1)[-1], r.reason, r.record.split(";")[0]) for r in C.bad_rows(rows).collect()}
    assert bad == {("c.csv", C.TOO_FEW, "7"), ("c.csv", C.TOO_MANY, "8"), ("c.csv", C.OPEN_QUOTE, "10")}
    assert C.bad_rows(rows).count() == 3
    got = C.read_cases(spark, str(tmp_path)).select("case_id", "extra_info", "aadt_total").collect()
    assert {tuple(r) for r in got} == {(7, "short", None), (9, 'fine;"x"', 2.0)}
