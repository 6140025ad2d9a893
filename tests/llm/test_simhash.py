"""Fingerprints, components and the kept rows against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA, corpus, lower, words

from casework.llm import simhash


def fingerprint(text, k=4):
    w = words(lower(text))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def components(fps, distance):
    """The fingerprints reachable from each."""
    left, out = set(fps), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            todo += near
        for x in seen:
            out[x] = frozenset(seen)
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_components(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "fp").withColumnRenamed("lang", "root").repartition(4)
    of = components([fingerprint(t) for _, t, *_ in rows], simhash.DISTANCE)
    want = Counter()
    for d, t, *_ in rows:
        group = of[fingerprint(t)]
        ids = [i for i, u, *_ in rows if fingerprint(u) in group and i is not None]
        want[d, fingerprint(t), min(ids) if ids else None] += 1
    got = Counter((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_one_row_of_each_component_stays(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "fp").repartition(4)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    of = components([fingerprint(t) for _, t, *_ in rows], simhash.DISTANCE)
    groups = Counter(of[fingerprint(r.text)] for r in kept.collect())
    assert set(groups) == set(of.values()) and set(groups.values()) == {1}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.dedup(empty).count() == 0


@pytest.mark.parametrize("segments,distance", [(3, 4), (2, 4), (4, 4), (3, 2)])
def test_links_of_dense_and_sparse_fingerprints(segments, distance):
    rng = np.random.default_rng(segments)
    center = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = [rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for c in center:  # dense balls: buckets that are cut again
        flips = rng.integers(0, 64, (400, 3))
        fps.append(c ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1))
    fps = np.unique(np.concatenate(fps))
    x, y = simhash.links(*simhash.entries(fps, distance, segments), distance).forest()
    assert (np.bitwise_count(x ^ y) <= 64).all()
    root = {int(f): int(f) for f in fps}
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        root[a] = b
    got = {}
    for f in fps.tolist():
        r = f
        while root[r] != r:
            r = root[r]
        got.setdefault(r, set()).add(f)
    assert set(map(frozenset, got.values())) == set(components(fps.tolist(), distance).values())


def test_a_star_with_very_many_links_is_dealt_into_parts(spark):
    """A node of most links, chains and repeats: the same components."""
    from casework.llm.graph import connected_components
    star = [(500, i) for i in range(1000, 4500)] + [(i, i + 1) for i in range(5000, 5040)] + [(500, 1000), (7, 7), (4499, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(star, "a long, b long")).collect()}
    want = {i: 3 for i in [500, 3, *range(1000, 4500)]} | {i: 5000 for i in range(5000, 5041)}
    assert got == want
