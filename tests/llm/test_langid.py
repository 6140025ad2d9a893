"""Language identification: automata against plain search, awkward rows, held-out accuracy."""

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import langid
from casework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def _phrases(known, text):
    """Longest matches by plain search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in known:
            size += 1
        at, n = at + size, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abcd", max_size=40))
def test_phrases_are_longest_matches(known, text):
    assert langid.phrases(langid.automaton(known), text) == _phrases(known, text)


def _said(lang, k):
    words = {"x1": ["lorem", "ipsum", "dolor", "sit"], "x2": ["Straße", "über", "köln", "fünf"]}[lang]
    return " ".join(words[(k * 7 + i * i) % 4] for i in range(12))


def _rows():
    rows = [(i, _said(lang, i), lang, "s") for i in range(60) for lang in [("x1", "x2")[i % 2]]]
    rows += [(100, None, "x1", None), (101, "", "x1", None), (102, "12 -- 34 ² !", "x2", "s"), (103, "lorem ipsum dolor " * 20_000, None, None),
             (None, "über köln fünf", None, None), (104, "über köln", "x1", "s"), (104, "über köln", "x1", "s"), (None, None, None, None)]
    return rows + [(200 + i, _said("x1", 0), "x1", "s") for i in range(40)]  # a third are copies


def test_awkward_rows(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA).selectExpr("*", "1 as h", "2 as n", "3 as share", "4 as score").repartition(5)
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert len(found) == len(_rows())
    texts = {}
    for i, t, *_ in _rows():
        texts.setdefault(i, []).append(t)
    for r in found:
        assert r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 1)
        if r.id in (100, 101, 102):
            assert (r.lang, r.score) == ("und", 0.0)
        elif r.id is not None and r.id < 60:
            assert r.lang == ("x1", "x2")[r.id % 2] and 0.5 < r.score <= 1
    assert {r.lang for r in found if r.id == 103} == {"x1"}
    assert {r.lang for r in found if r.id is None} == {"x2", "und"}
    assert {r.lang for r in found if r.id == 104} == {"x2"}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, langid.learn(none)).count() == 0
    docs = spark.createDataFrame([(1, "some words", None, None), (2, None, None, None)], SCHEMA)
    assert {tuple(r) for r in langid.identify(docs, langid.learn(docs)).select("lang", "score").collect()} == {("und", 0.0)}


def test_only_learned_folds_matter(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    other = spark.createDataFrame([(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else lang, s)
                                   for i, t, lang, s in rows], SCHEMA)
    assert langid.learn(docs).texts == langid.learn(other).texts


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    bounds = langid.Sample(lang_chars=200, total_chars=300, passage_chars=50)
    texts = langid.learn(docs, bounds).texts
    assert set(texts) == {"x1", "x2"} and all(0 < len(t) <= 160 for t in texts.values())


def test_held_out_accuracy(spark):
    found = QUERIES["op11_language"](spark, SF)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    told = found.join(docs, "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as double)) as a", "count(*) as n").first()
    assert found.count() == docs.count() and told.n > 300 and told.a > 0.98
