"""Hard negatives against brute force; bounds; repeated ids in the top-k search."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import hard_negatives, topk, vector_shards
from casework.llm.queries import OP4_SQL, OP13_SQL

SCHEMA = "vec_id long, label int, embedding array<float>"


def _rows(seed=0, n=300, dim=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    x = (centre[rng.integers(0, 4, n)] + 0.4 * rng.normal(size=(n, dim))).round(2)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    label = rng.integers(0, 4, n)
    rows = [(int(i), int(y), [float(v) for v in p]) for i, y, p in zip(rng.permutation(n), label, x, strict=True)]
    rows += [(n, 1, None), (n + 50, None, rows[3][2]), (n + 100, 1, [math.nan] * dim), (n + 150, 2, [None] + [1.0] * (dim - 1)),
             (n + 200, 0, []), (None, 1, rows[4][2]), (n + 250, 1, [math.inf] * dim), (0, 3, rows[5][2]), (0, 3, rows[5][2]),
             (7, 1, rows[6][2]), (50, 1, [0.0] * dim), (n + 300, 1, [1.0, 2.0]), (n + 301, 1, [2.0, 2.0]), (n + 302, 2, [1.0, 1.5]),
             (n + 350, 9, rows[8][2]), (n + 351, 0, [-v for v in rows[8][2]])]
    return rows


def _mined(rows, low=50, high=95):
    single = np.float32
    own = [(i, y, [math.floor(256 * float(single(v))) for v in x]) for i, y, x in rows
           if i is not None and y is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (i, y, x) in enumerate(own):
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, z, strict=True)), j, w == y) for b, (j, w, z) in enumerate(own) if b != a and len(z) == len(x)]
        for p, pid, _ in sorted(s for s in scored if s[2])[:5]:
            fit = sorted((s, j) for s, j, same in scored if not same and low * -p <= 100 * -s <= high * -p)
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(fit[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_hard_negatives(spark, shard_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as shard", "3 as dim", "4 as place").repartition(5)
    got = hard_negatives.mine(df, shard_rows=shard_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows)


def test_no_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(50, 1, [1.0])], SCHEMA)
    assert hard_negatives.mine(alone).count() == 0


def test_against_sql(spark):
    rows = _rows(3, 200, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    embeddings = df.toArrow()  # noqa: F841
    turned = df.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label", "embedding")
    got = sorted(tuple(r) for r in hard_negatives.mine(turned, shard_rows=50).collect())
    assert got == sorted(duckdb.sql(OP13_SQL).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(0, 2**31))
def test_bounds_hold(n, dim, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-90, 90, (n, dim)), rng.integers(-90, 90, (3, dim))
    score = q @ x.T
    low, high = hard_negatives.shard_bounds(q, hard_negatives.shard_summary(x)[None])
    assert (low[:, 0] <= score.min(axis=1)).all() and (score.max(axis=1) <= high[:, 0]).all()
    for segments in hard_negatives.LEVELS:
        (m, d), (a, b) = (hard_negatives.segment_summary(v, segments) for v in (q, x))
        assert (np.abs(score - m @ a.T) <= d @ b.T + 1e-6).all()


def test_top_k_keeps_rows_of_one_id_apart(spark):
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, 1.0]), (20, [1.0, 1.0]), (20, [2.0, 2.0]), (20, [2.0, 2.0])]
    vectors += [(i, [i / 7, -i / 5]) for i in range(3, 90)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    embeddings = df.toArrow()  # noqa: F841
    want = sorted(duckdb.sql(OP4_SQL).fetchall())
    for shard_rows in (16_384, 12):
        assert sorted(tuple(r) for r in topk.top_k(df, shard_rows=shard_rows).collect()) == want
    assert (0, 1, 1, 61440) in {r for r in want}


def test_queries_see_few_shards_of_clustered_vectors(spark):
    """Rows are moved once; queries go only where the bound lets them."""
    rng = np.random.default_rng(5)
    sent = {}
    for n in (1000, 2000, 4000):
        x = np.eye(8)[np.arange(n) % 8] * 3 + 0.05 * rng.normal(size=(n, 8))
        df = spark.createDataFrame([(i, int(i % 8), [float(v) for v in p]) for i, p in enumerate(x)], SCHEMA)
        shards = vector_shards.dealt(vector_shards.whole_rows(df, 64, label_col="label"), n // 8)
        held = vector_shards.summaries(shards, hard_negatives.shard_summary, hard_negatives._join_summaries)
        asked = shards.where("id % 50 = 0").selectExpr("row", "id", "label", "dim", "vec")
        near = vector_shards.routed(asked, held, lambda q, v, s, loads: hard_negatives.shard_bounds(v, loads)[1] >= 64 * 64 * 8)
        sent[n] = near.count() / asked.count()
    assert max(sent.values()) <= 3
