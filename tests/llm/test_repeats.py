"""Word windows and byte strings against brute force."""

from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, corpus, rank, sha, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casework.llm import bwt_repeats, recompress
from casework.llm.blocks import Words


def word_brute(rows, window):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: rank(r[0])):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), rank(d))
    out = Counter()
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < rank(d):
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, len(w), sum(gone), sha(kept.encode())] += 1
    return out


def byte_brute(rows, length):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: rank(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], rank(d))
    out = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < rank(d):
                gone[i:i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))] += 1
    return out


def _ids(df):
    return df.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id")


@pytest.mark.parametrize("seed", [0, 1])
def test_word_windows(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "block").withColumn("id", F.lit("clash")).repartition(5)
    got = Counter(tuple(r) for r in _ids(recompress.repeated_windows(docs)).collect())
    assert got == word_brute(rows, recompress.WINDOW)


def test_word_windows_of_no_rows(spark):
    assert recompress.repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed,hot", [(0, bwt_repeats.HOT_CONTEXTS), (1, 3)])
def test_byte_strings(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "load").withColumn("no_id", F.lit(1)).repartition(5)
    got = Counter(tuple(r) for r in _ids(bwt_repeats.repeated_strings(docs, hot=hot)).collect())
    assert got == byte_brute(rows, bwt_repeats.LENGTH)


def test_byte_strings_of_no_rows(spark):
    assert bwt_repeats.repeated_strings(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.lists(st.integers(0, 3), max_size=20), st.integers(3, 9))
def test_equal_windows_have_equal_anchors(base, other, window):
    """Whatever surrounds them: the law on which the search for candidates rests."""
    texts = [" ".join("abcd"[x] for x in t) for t in (base, other + base[3:] + other, base[2:-1] + other)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    w = recompress.Windows(Words(np.frombuffer(b"".join(raw), np.uint8), offsets), window)
    anchors, seen = w.anchors(), {}
    letters = [x for t in texts for x in t.split()]
    for s, a in zip(w.start, anchors, strict=True):
        assert seen.setdefault(tuple(letters[s:s + window]), a) == a


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=40), min_size=1, max_size=8))
def test_interval_expansion(contexts):
    contexts = [c.encode() for c in contexts]
    owner = np.arange(len(contexts))[::-1].copy()
    found = bwt_repeats.smallest_owner(contexts, owner, 4)
    strings = [c[i:i + 4] for c in contexts for i in range(len(c) - 3)]
    assert found.tolist() == [min(o for o, d in zip(owner, contexts, strict=True) if s in d) for s in strings]
