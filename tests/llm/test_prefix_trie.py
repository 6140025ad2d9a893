"""The prefix trie against a plain one; radix tree layouts; SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import prefix_trie as pt
from casework.llm.queries import OP12_SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def _rows(seed=0, n=260):
    rng = random.Random(seed)
    said = [("user", "hi"), ("assistant", "hello é"), ("user", None), (None, "x"), ("user", ""), ("bot", "😀 ok"), ("1:user", "x"), ("us", "erhi")]
    rows = []
    for c in rng.sample(range(0, 700), n):
        turns = [rng.choice(said[:rng.randint(1, 8)]) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.6:
            turns[:3] = said[:3]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(c, t, "user", "copied") for c in range(10_000, 10_150) for t in range(4)]          # a third are copies
    rows += [(20_000, t, "user", f"turn {t % 700}") for t in range(9_000)]                       # one long conversation
    rows += [(30_007, None, "user", "late"), (30_007, 0, "user", "next"), (30_007, None, None, None), (30_007, 0, "user", "next"),
             (-5, 0, "user", "hi"), (-105, 0, "user", "hi"), (None, 0, "user", "hi"), (None, None, None, None), (30_100, 0, None, None)]
    rng.shuffle(rows)
    return rows


def _trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            key = hashlib.md5(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, key, turn))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = own.get(base, [])[:h] + own[c][h:]
        path = ()
        for depth in range(len(seq) + 1):
            path = (path, seq[depth - 1]) if depth else ()
            members.setdefault((depth, path), []).append(c)
        ends.setdefault((depth, path), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in sorted(members, key=lambda x: -x[0]):
        depth, path = node
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * len(path[1][1]) if depth else 0)
        if depth:
            up = (depth - 1, path[0])
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return sorted((min(m), d, min(members[d - 1, p[0]]) if d else -1, len(m), kids.get((d, p), 0), leaves[d, p], saved[d, p], sha(ends.get((d, p), [])))
                  for (d, p), m in members.items())


def _got(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


@pytest.mark.parametrize("tree_keys", [50_000, 25])
def test_trie(spark, tree_keys):
    rows = [r for r in _rows() if r[0] != 20_000 or (r[1] or 0) < 300]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as name", "2 as depth", "3 as runs", "4 as id").repartition(7)
    got = pt.prefix_trie(df, tree_keys=tree_keys)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert _got(got) == _trie(rows)


def test_against_sql_with_long_and_odd_rows(spark):
    rows = [r for r in _rows(4) if r[0] != 20_000 or (r[1] or 0) < 400]
    df = spark.createDataFrame(rows, SCHEMA)
    conversations = df.toArrow()  # noqa: F841
    assert _got(pt.prefix_trie(df, tree_keys=40)) == sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in duckdb.sql(OP12_SQL).fetchall())


def test_long_conversation(spark):
    rows = [r for r in _rows() if r[0] in (20_000, 30_007)]
    found = pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6)).where("conv_id = 20000")
    assert found.selectExpr("max(depth)", "count(*)", "min(n_leaves)").first() == (9_000, 9_001, 1)


def test_no_rows(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=400))
def test_radix_tree(keys):
    keys = sorted(keys)
    random.Random(1).shuffle(keys)
    tree = pt.RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)
    found, todo = {}, [(tree.root, tree.root.path)]
    while todo:
        node, key = todo.pop()
        if node.row >= 0:
            found[key] = node.row
        items = node.kids.items()
        assert [b for b, _ in items] == sorted(b for b, _ in items) and all(node.kids.get(b) is kid for b, kid in items)
        assert node.row >= 0 or len(items) > 1 or node is tree.root
        todo += [(kid, key + bytes([b]) + kid.path) for b, kid in items]
    assert found == {key: row for row, key in enumerate(keys)}


def test_node_layouts_grow():
    kids, kinds = pt.Few(), []
    order = list(range(256))
    random.Random(2).shuffle(order)
    for i, b in enumerate(order):
        kids = kids.put(b, b)
        if i + 1 in (4, 5, 16, 17, 48, 49, 256):
            kinds.append((type(kids).__name__, getattr(kids, "room", None)))
        assert [b for b, _ in kids.items()] == sorted(order[:i + 1]) and kids.get(order[i]) == order[i]
    assert kinds == [("Few", 4), ("Few", 16), ("Few", 16), ("Indexed", None), ("Indexed", None), ("Full", None), ("Full", None)]
