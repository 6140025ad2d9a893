"""Decontamination against an exhaustive search of all documents and items."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import decontaminate as dc
from casework.llm.terms import Terms

ITEMS = 260  # more than the rank


def _texts(words_an_item, seed):
    """Items, and documents that hold some of them with a share of the words replaced."""
    rng = np.random.default_rng(seed)
    letters = random.Random(seed)
    vocab = ["".join(letters.choice("abcdefghijklmnop") for _ in range(letters.randint(2, 7))) + str(i) for i in range(3000)]
    weight = 1 / np.arange(1, len(vocab) + 1)
    say = lambda n: [vocab[i] for i in rng.choice(len(vocab), n, p=weight / weight.sum())]
    items = [say(words_an_item) for _ in range(ITEMS)]
    docs, planted = [], []
    for i in range(150):
        w = say(int(rng.integers(0, 400)))
        if i % 2 == 0:
            j, share = int(rng.integers(0, ITEMS)), float(rng.choice([0.0, 0.1, 0.25]))
            own = [x if rng.random() >= share else say(1)[0] for x in items[j]]
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = own
            planted.append((i, j, share))
        docs.append((i, " ".join(w)))
    return docs, [(j, " ".join(w)) for j, w in enumerate(items)], planted


def _exhaustive(docs, items, s=dc.Settings()):
    """Every pair that passes the word checks in the window of any passage."""
    out = set()
    names = lambda t: Terms.of([t]).names().tolist()
    own = [(j, names(t)) for j, t in items]
    for i, text in docs:
        words = names(text)
        for j, item in own:
            n, tail = len(item), item[len(item) - dc._answer_words(items[j][1]):]
            masks, tail_masks = ({w: sum(1 << k for k, x in enumerate(v) if x == w) for w in v} for v in (item, tail))
            for first in range(0, len(words), s.stride):
                part = [w for w in words[max(0, first - n):first + 2 * s.stride + n] if w in masks]
                if len(part) >= s.overlap * n:
                    share = dc._length(dc.common_subsequence(masks, n, part), n) / n
                    got = dc._length(dc.common_subsequence(tail_masks, len(tail), part), len(tail)) / len(tail)
                    if share >= s.overlap and got >= s.answer:
                        out.add((i, j))
                        break
    return out


@pytest.mark.parametrize("words_an_item,basis", [(40, 200_000), (40, 1500), (120, 1500)])
def test_recall(spark, words_an_item, basis):
    docs, items, planted = _texts(words_an_item, words_an_item)
    found = dc.hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                    spark.createDataFrame(items, "item_id long, text string"), dc.Settings(basis_passages=basis))
    got, want = {(r.id, r.item_id) for r in found.collect()}, _exhaustive(docs, items)
    assert got <= want
    assert len(got & want) >= 0.95 * len(want)
    assert {(i, j) for i, j, share in planted if share == 0} <= got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
def test_counts_of_rarer_words(words, data):
    """Running counts of an item's rarer words equal a plain count by strides."""
    item = data.draw(st.lists(st.integers(0, 5), min_size=1, max_size=6))
    m = dc.Matcher([], dc.Settings())
    m.vocab, m.items = np.arange(6, dtype=np.uint64), [dc.Item(1, np.array(item), 1, {}, {})]
    frequent = data.draw(st.lists(st.booleans(), min_size=6, max_size=6))
    m.set_idf(np.where(frequent, 100, 1), 100)
    terms = np.array(words, np.int32)
    offsets = np.array([0, len(words)])
    upto = m.rare_upto(m.items, m.stride_terms(terms, offsets, dc.passage_base(offsets, m.settings.stride)))
    rare = [w in item and not frequent[w] for w in words]
    assert upto[:, 0].tolist() == [sum(rare[:k * 16]) for k in range(-(-len(words) // 16) + 1)]
    assert m.rare_least[0] == pytest.approx(0.6 * len(item) - sum(frequent[w] for w in item), abs=1e-6)


def test_items_are_summed_some_at_a_time():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 50, rng.integers(1, 30)) for _ in range(600)]
    idf, q = rng.random(50).astype(np.float32) + 0.1, rng.standard_normal((50, 7))
    rows = np.zeros((600, 50))
    for i, w in enumerate(items):
        np.add.at(rows[i], w, idf[w])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.allclose(dc.items_times(items, idf, q), rows.T @ (rows @ q), atol=1e-4)


@pytest.mark.parametrize("pair_bytes", [dc._PAIR_BYTES, 0])
def test_gram_of_all_passages(spark, monkeypatch, pair_bytes):
    """Sums over pairs of terms, and over passages, equal the plain product."""
    monkeypatch.setattr(dc, "_PAIR_BYTES", pair_bytes)
    monkeypatch.setattr(dc, "_SLICE", 16)
    rng = np.random.default_rng(4)
    texts = [rng.integers(-1, 50, rng.integers(0, 90)).astype(np.int32) for _ in range(40)]
    idf, q = rng.random(50).astype(np.float32) + 0.1, rng.standard_normal((50, 7))
    rows = []
    for t in texts:
        for i in range(0, len(t), 16):
            row = np.zeros(50)
            np.add.at(row, t[i:i + 16][t[i:i + 16] >= 0], 1)
            row *= idf
            rows.append(row / max(np.linalg.norm(row), 1e-9))
    rows = np.array(rows)
    encoded = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "terms binary").repartition(3)
    assert np.allclose(dc.gram_times(encoded, idf, q, 16), rows.T @ (rows @ q), atol=1e-4)


def test_parts_of_a_table_do_not_multiply_the_sums(spark, monkeypatch):
    """Each task sends a matrix of terms x rank: a small table in many parts has few such tasks."""
    seen, fit = [], dc.latent_basis
    monkeypatch.setattr(dc, "latent_basis", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or fit(rows, *a))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        item = "one two three four five six seven eight. nine ten"
        docs = spark.createDataFrame([(i, f"w{i} {item} w{i}") for i in range(60)], "doc_id long, text string").repartition(40)
        found = dc.hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
        assert found.count() == 60
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
