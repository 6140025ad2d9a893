"""Scalar functions on hand-made edge rows (FIXTURES F1/F2/F4/F8)."""

from pyspark.sql import functions as F

from casework.functions import clean, derive, text
from casework.operators import policy


def rows(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_curve_category_boundaries(spark):
    vals = [99999.0, 3000.0, 2999.9, 1000.0, 500.0, -600.0, 0.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "r double")
    got = rows(df, derive.curve_category("r"))
    assert got == ["Rett veg", "Rett veg", "Veldig slak sving (svingradius 2999.9m)",
                   "Veldig slak sving (svingradius 1000.0m)", "Slak sving (svingradius 500.0m)",
                   "Slak sving (svingradius 600.0m)", "Krapp sving", "Ukjent"]
    lab = rows(df.withColumn("c", derive.curve_category("r")), derive.turn_label("c", "r"))
    assert lab[6] == "Sving (svingradius 0.0m)" and lab[0] == "Rett veg"


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(0.0499,), (0.05,), (0.4999,), (0.5,)], "p double")
    assert rows(df, derive.risk_band("p")) == [derive.BAND_LOW, derive.BAND_MEDIUM,
                                               derive.BAND_MEDIUM, derive.BAND_HIGH]
    df2 = spark.createDataFrame([(4.9,), (5.0,), (50.0,)], "p double")
    assert rows(df2, derive.risk_band("p", 100)) == [derive.BAND_LOW, derive.BAND_MEDIUM, derive.BAND_HIGH]


def test_parse_number_locale(spark):
    vals = ["1 234,5", "1 234", " 12,25 ", "abc", "", None, "NaN"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert rows(df, clean.parse_number("s")) == [1234.5, 1234.0, 12.25, None, None, None, None]


def test_squash_and_outcomes(spark):
    df = spark.createDataFrame([(" Mindre  streng ",), ("Avslag",), ("Avslag etter klage ",), (None,)],
                               "s string")
    assert rows(df, clean.squash_space("s"))[0] == "Mindre streng"
    assert rows(df, clean.binary_outcome("s")) == ["Godkjent", "Avslag", "Godkjent", "Godkjent"]
    assert rows(df, clean.reject_flag("s")) == [0, 1, 1, 0]


def test_road_reference_parse(spark):
    df = spark.createDataFrame([("EV6 S1D1 m1234.5",), ("FV30 S2D1 m20 K1",), ("RV3 S1D1",)], "r string")
    assert rows(df, derive.road_part("r")) == ["EV6 S1D1", "FV30 S2D1", "RV3 S1D1"]
    assert rows(df, derive.road_meter("r")) == [1234.5, 20.0, None]


def test_first_property(spark):
    df = spark.createDataFrame([([("Klasse", "A"), ("Klasse", "B")],), ([("Annet", "x")],), ([],)],
                               "p array<struct<name:string,value:string>>")
    assert rows(df, derive.first_property("p", "Klasse")) == ["A", "", ""]


def test_received_date_bad_dates(spark):
    df = spark.createDataFrame([("28.05.2025",), ("31.02.2025",), ("",), (None,)], "d string")
    got = rows(df, derive.received_date("d"))
    assert str(got[0]) == "2025-05-28" and got[1:] == [None, None, None]


def test_rule_reject_nulls(spark):
    data = [("Lite streng", 50.0, "Rett veg", None, False),
            ("Lite streng", 61.0, "Rett veg", None, True),      # missing type is not exempt
            ("Lite streng", 60.0, "Rett veg", "Ny", False),     # 60 is not above 60
            ("Lite streng", 80.0, "Rett veg", "Utvidet bruk", False),
            ("Lite streng", 50.0, "Krapp sving", "Endret bruk", False),
            ("Lite streng", 50.0, "Krapp sving", "Ny", True),
            (None, 50.0, "Rett veg", "Ny", True),
            ("Streng", None, None, None, True)]
    df = spark.createDataFrame(data, "pc string, sp double, cu string, ty string, want boolean")
    got = df.select(policy.rule_reject("pc", "sp", "cu", "ty").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_reply_parsers(spark):
    data = [('{"approve": true, "reason": "ok"}', None), ('```json\n{"approve": false}\n```', None),
            ('```\n{"approve": true}```', None), ('{"reason": "x"}', None), ("", None),
            ("not json", None), ("{}", "timeout")]
    df = spark.createDataFrame(data, "reply string, error string")
    dec, reason = text.parse_reply_strict("reply", "error")
    got = df.select(dec.alias("d"), reason.alias("r"), text.parse_reply_lenient("reply", "error").alias("l")).collect()
    assert [r.d for r in got] == ["Godkjent", "Avslag", "Godkjent", "Avslag", "Feil", "Feil", "Feil"]
    assert got[1].r == text.DEFAULT_REASON and got[0].r == "ok" and got[6].r == "timeout"
    assert [r.l for r in got] == ["Godkjent", "Avslag", "Godkjent", "Avslag", "Avslag", "Avslag", "Feil"]


def test_explanation_text(spark):
    fac = [("a", 1.0, 0.2), ("b", 2.0, -0.1), ("c", 3.0, 0.05), ("d", 4.0, -0.3), ("e", 5.0, 0.01),
           ("f", 6.0, 0.3), ("g", 7.0, -0.2), ("h", 8.0, -0.01)]
    df = spark.createDataFrame([(0.42, fac)], "p double, f array<struct<name:string,value:double,contribution:double>>")
    t = df.select(text.explanation_text("p", "f")).first()[0]
    assert t.startswith("Sannsynlighet for avslag: 42.0 %\nKategori: medium")
    up = t.split("ØKER sannsynligheten for avslag:\n")[1].split("\n\n")[0].split("\n")
    down = t.split("REDUSERER sannsynligheten for avslag:\n")[1].split("\n")
    assert [x.split(" (")[0].strip("• ").strip() for x in up] == ["f", "a", "c"]
    assert [x.split(" (")[0].strip("• ").strip() for x in down] == ["b", "g", "d"]
    assert "effekt: +0.3" in up[0] and "effekt: -0.3" in down[2]
    none = spark.createDataFrame([(0.01, [("a", 1.0, -0.1)])], df.schema)
    assert text.NO_FACTORS in none.select(text.explanation_text("p", "f")).first()[0]
