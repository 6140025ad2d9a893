"""Exact top-k and personal data against brute force."""

import math
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import pii, topk


def _vectors(seed=0, n=400, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(1)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    rows = [(int(i), [float(v) for v in x[i]]) for i in rng.permutation(n)]
    rows += [(n, None), (n + 20, [1.0] * (dim - 1) + [math.nan]), (n + 40, [None] + [1.0] * (dim - 1)), (n + 60, []),
             (n + 80, [math.inf] * dim), (None, [1.0] * dim), (n + 100, [1.0] * 3), (n + 101, [2.0] * 3), (rows[0][0], rows[0][1])]
    return rows


def _top(rows, k, every):
    single = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    own = {i: [math.floor(64 * single(v)) for v in x] for i, x in rows
           if i is not None and x and all(v is not None and math.isfinite(v) for v in x)}
    out = set()
    for q, x in own.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in own.items() if i != q and len(y) == len(x))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows,query_rows", [(8192, 1024), (60, 7)])
def test_top_k(spark, shard_rows, query_rows):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as shard", "2 as kth").repartition(4)
    got = {tuple(r) for r in topk.top_k(df, 20, 20, shard_rows=shard_rows, query_rows=query_rows).collect()}
    assert got == _top(rows, 20, 20)


def test_top_k_of_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 80), st.integers(1, 5), st.integers(1, 6), st.integers(0, 2**31))
def test_tree_search(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    points, ids = rng.integers(-3, 4, (n, dim)), rng.permutation(n)
    queries, qids = rng.integers(-3, 4, (5, dim)), np.arange(5)
    tree = topk.Tree.build(ids, points, leaf=4)
    who, found, score = tree.search(qids, queries, np.full(5, topk.NONE), k)
    for q in range(5):
        want = sorted((-int(points[j] @ queries[q]), int(ids[j])) for j in range(n) if ids[j] != q)[:k]
        assert [(-s, i) for w, i, s in zip(who.tolist(), found.tolist(), score.tolist(), strict=True) if w == q] == want


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+- 0(25é", max_size=60))
def test_plain_spans(text):
    assert pii.plain_spans(text) == plain(text)


DISGUISED = [
    ("mail {} now", "john.doe [at] example [dot] com", "email"),
    ("write to {} please", "jane at mail4 dot example dot com", "email"),
    ("{}", "jоhn@exаmple.com", "email"),
    ("x {} y", "ｊｏｈｎ@ｅｘａｍｐｌｅ．ｃｏｍ", "email"),
    ("é {}!", "a​b@exa​mple.com", "email"),
    ("call {} ok", "plus one nine eight eight five five five two four eight five", "phone"),
    ("ring {}.", "+١ (988) 555-2485", "phone"),
    ("pay {} today", "four zero four one eight nine four nine seven four six zero eight seven nine five", "card"),
    ("at {} and", "192 dot 168 dot 1 dot 77", "ip"),
    ("host {} up", "10[.]0[.]0[.]1", "ip"),
    ("ist {} da", "eins neun zwei punkt eins sechs acht punkt null punkt eins", "ip"),
]


@pytest.mark.parametrize("frame,secret,kind", DISGUISED)
def test_disguises_map_back_to_the_source(frame, secret, kind):
    text = frame.format(secret)
    assert pii.plain_spans(text) == []
    assert [(k, text[i:j]) for k, i, j in pii.added_spans(text, [])] == [(kind, secret)]


@pytest.mark.parametrize("text", ["", "look at the dot on paper. at home.", "un deux trois", "meet me at noon. one two three",
                                  "the only one at work, at 5.30 dot", "un un un un un un un un un un un un", "a 1.2.3 b 300.1.1.1"])
def test_clean_text_stays_clean(text):
    assert pii.added_spans(text, pii.plain_spans(text)) == []


PARTLY = [
    ("at {} now", "one dot two dot three dot four", "ip"),
    ("at {}!", "192 dot 168 dot one dot one", "ip"),
    ("host '{}'", "192 dot 168 dot 1 dot one", "ip"),
    ("host {} up", "192.168.one.one", "ip"),
    ("host {} up", "10 dot 16 eight dot 0 dot 1", "ip"),
    ("pay {} today", "4111 1111 1111 one one one one", "card"),
    ("pay {} today", "4111-1111-1111-111-one", "card"),
    ("call {} ok", "plus one 988 555 2485", "phone"),
    ("call {} ok", "+1 988 555 two four eight five", "phone"),
]


@pytest.mark.parametrize("frame,secret,kind", PARTLY)
def test_partly_spelled_ones_are_found(frame, secret, kind):
    text = frame.format(secret)
    assert [(k, text[i:j]) for k, i, j in pii.added_spans(text, pii.plain_spans(text))] == [(kind, secret)]


@pytest.mark.parametrize("text", ["see 1.2.3. One of two", "one 2.5.1 two", "4111 1111 1111 one one one two", "one, 10, 15, 20, 25, 30, 40",
                                  "one dot two dot three", "300 dot one dot one dot one", "it is one point five, plus two"])
def test_partly_spelled_figures_that_are_none_stay_clean(text):
    assert pii.added_spans(text, pii.plain_spans(text)) == []


def test_a_digit_before_a_spelled_address_costs_nothing():
    text = "one 192 dot 168 dot 1 dot 77"
    assert [(k, text[i:j]) for k, i, j in pii.added_spans(text, [])] == [("ip", "192 dot 168 dot 1 dot 77")]


def test_plain_ones_stay(spark):
    rng = random.Random(3)
    mail = "bob@example.com"
    texts = [f"{mail} and {DISGUISED[0][1]} and +1 (988) 555-2485", mail + "​", None, "", "word " * 5000 + mail, "1" * 50_000,
             "".join(rng.choice("ab1.@+ -") for _ in range(20_000))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], None), (0, texts[0], "x")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id is None:
            continue
        text = texts[r.id] or ""
        base = plain(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{i}:{j}" for k, i, j in base} <= set(spans) and len(spans) == len(base) + r.n_added
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["john(  at)host.com", "john(\tat)host.com", "john_doe\tat\thost.com", "a.b <  @> c.org",
                                  "john [ at ] host [\tdot ] com", "John_1 AT\nHost.Org"])
def test_white_space_hides_no_disguise(text):
    assert [k for k, *_ in pii.added_spans(text, pii.plain_spans(text))] == ["email"]


def test_no_hint_means_no_find():
    rng = random.Random(8)
    parts = ["john", "a.b", "x_1", " at ", "\tat\t", "@", "(at)", "[ AT ]", "{ @ }", "<\t.\t>", " dot ", " punkt ", ".", "host", "com", " ", "org",
             "12", "\n", "(", "one "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(2, 9)))
        a = pii.Aligned(text)
        changed = pii.at_and_dot(a) and a.text != text
        assert not changed or pii._may_hide(text)[2], text


def test_many_finds_take_linear_time():
    import time
    text = " ".join(f"user_{i} at host{i} dot com" for i in range(8000))
    begin = time.process_time()
    assert len(pii.added_spans(text, pii.plain_spans(text))) == 8000
    assert time.process_time() - begin < 2
