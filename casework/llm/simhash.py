"""SimHash near-duplicates by multi-index hashing (operator 6).

A document's fingerprint has bit i if bit i is set in over half of the XXH64
values of its word shingles.  Fingerprints within ``distance`` bits are linked;
a document's component is named after the smallest doc_id in it.

The 64 bits are cut into ``segments``.  Two fingerprints within ``distance``
bits agree in some segment up to ``distance // segments`` bits, so each
fingerprint is filed under its own value of every segment and looks up every
value of the small Hamming ball around it (only values not below its own: the
other side looks up the rest).  Matches are verified on all 64 bits.  The
bucket of one value gives back a spanning forest of its links, not all pairs,
and a bucket with many fingerprints is cut again by the other segments.  With n
fingerprints about 64 / log2(n) segments are best; any number is right.

Defined results: a null or empty text has fingerprint zero and links like any
other; equal fingerprints are one node, so copies are never paired; repeated
rows and equal doc_ids keep their rows; a null doc_id never names a component
that holds another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.blocks import bucket_bounds, groups, mix64, packed, unpacked
from casework.llm.graph import connected_components, local_roots
from casework.session import materialize

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
SEED = 42
#: a bucket with more fingerprints is cut again; its pairs are otherwise compared
_DENSE = 512
_RUN = 1 << 16
_SALTS = 32
#: fingerprints for each bucket of the exchange, about 600 bytes of entries each
_BUCKET_NODES = 20_000
U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist()
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(starts), _RUN):
        h = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED)
                      for i, j in zip(starts[at:at + _RUN], ends[at:at + _RUN], strict=True)], ">u8")
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long with the fingerprint's bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _ball(bits: int, radius: int) -> np.ndarray:
    """All patterns of at most ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], U)


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def entries(fps: np.ndarray, distance: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, own): every fingerprint under its own segment values and those it looks up."""
    keys, whose, own = [], [], []
    for s, (shift, width) in enumerate(_cuts(64, segments)):
        value = (fps >> U(shift)) & U((1 << width) - 1)
        for pattern in _ball(width, distance // segments):
            near = value ^ pattern
            at = near >= value
            keys.append(mix64((near[at] << U(8)) | U(s)))
            whose.append(fps[at])
            own.append(np.full(int(at.sum()), pattern == 0))
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(own)


def _linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link for each node at most."""
    nodes, index = np.unique(np.concatenate([x, y]), return_inverse=True)
    root = nodes[local_roots(index[:len(x)], index[len(x):], len(nodes))]
    rest = root != nodes
    return nodes[rest], root[rest]


class _Links:
    """Links found so far, thinned to a forest as they grow."""

    def __init__(self):
        self.x, self.y, self.n = [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            self.x.append(x)
            self.y.append(y)
            self.n += len(x)
            if self.n > 1 << 20:
                self.x, self.y = ([v] for v in self.forest())
                self.n = len(self.x[0])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.x:
            return np.zeros(0, U), np.zeros(0, U)
        return _forest(np.concatenate(self.x), np.concatenate(self.y))


def _compare(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int, links: _Links) -> None:
    """Verify all pairs of equal key with at least one own; rows are sorted by key, own ones first."""
    first = groups(key)
    size = np.diff(np.append(first, len(key)))
    group = np.repeat(np.arange(len(first)), size)
    end = (first + size)[group]
    lead = np.flatnonzero(own & (np.arange(len(key)) + 1 < end))
    lag = 1
    while len(lead):
        hit = _linked(fp[lead], fp[lead + lag], distance)
        links.add(fp[lead[hit]], fp[lead[hit] + lag])
        lag += 1
        lead = lead[lead + lag < end[lead]]


def links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int, depth: int = 0) -> _Links:
    """A forest of the links among entries of equal key."""
    out = _Links()
    order = np.lexsort((~own, key))
    key, fp, own = key[order], fp[order], own[order]
    first = groups(key)
    size = np.diff(np.append(first, len(key)))
    dense = size > _DENSE if depth == 0 else np.zeros(len(size), bool)
    keep = np.repeat(~dense, size)
    _compare(key[keep], fp[keep], own[keep], distance, out)
    for i in np.flatnonzero(dense):
        # this bucket's fingerprints, filed by five narrower segments that must agree in one
        some = np.unique(fp[first[i]:first[i] + size[i]])
        out.add(*links(*entries(some, distance, distance + 1), distance, depth + 1).forest())
    return out


def linked_fingerprints(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS,
                        fp_col: str = "fp") -> DataFrame:
    """(a, b): edges that connect all fingerprints within ``distance`` bits, as a
    forest for each bucket range; the number of buckets grows with the ``nodes``,
    which are counted first."""
    n_buckets = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // _BUCKET_NODES))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column(0)).astype(np.int64).view(U)
            for at in range(0, len(fps), 1 << 15):
                key, fp, own = entries(fps[at:at + (1 << 15)], distance, segments)
                order = np.argsort(key)
                key, fp, own = key[order], fp[order], own[order]
                cut = bucket_bounds(key, n_buckets)
                rows = [(k, packed(key[i:j], fp[i:j], own[i:j]))
                        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                                 ["bucket", "load"])

    def meet(table: pa.Table) -> pa.Table:
        loads = [unpacked(x.as_py(), U, U, bool) for x in table.column("load")]
        x, y = links(*[np.concatenate([p[i] for p in loads]) for i in range(3)], distance).forest()
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return (nodes.select(F.col(fp_col).alias("fp")).mapInArrow(file, "bucket int, load binary")
            .groupBy("bucket").applyInArrow(meet, "a long, b long"))


def component_names(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(fp, component, root) of ``nodes`` (fp, low: the smallest id with it)."""
    roots = materialize(connected_components(linked_fingerprints(nodes, distance, segments)))
    alone = (nodes.join(roots, nodes.fp == roots.node, "left_anti")
             .select("fp", F.col("low").alias("component"), F.col("fp").alias("root")))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "low", "root")
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    # one component may hold very many fingerprints: its name is laid out once for each of _SALTS parts
    parts = lows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = linked.withColumn("_part", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int"))
    return alone.unionByName(dealt.join(parts, ["root", "_part"]).select("fp", "component", "root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component, root): one row for each row of ``docs``; ``root``
    names the component even where all its ids are null."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")))
    # one row for each fingerprint; rows of a frequent one are split by adaptive skew joins
    names = materialize(component_names(nodes, distance, segments))
    return rows.join(names, "fp").select("id", "fp", "component", "root")


def dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with its smallest (id, fingerprint,
    hash of the text); of rows equal in these any one.  All columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(fps, pa.int64()), b.column(2)], ["id", "fp", "h"])

    text = F.col(text_col)
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
                       .mapInArrow(run, "id long, fp long, h long"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")))
    names = materialize(component_names(nodes, distance, segments))
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "h")
    best = (rows.groupBy("fp", "id", "h").agg(F.count(F.lit(1)).alias("n")).join(names, "fp")
            .groupBy("root").agg(F.min_by(F.struct("id", "h", "n"), key).alias("k")).select("k.id", "k.h", "k.n"))
    best = materialize(best)

    def chosen(which: DataFrame) -> DataFrame:
        return docs.join(which, docs[id_col].cast("long").eqNullSafe(which["id"])
                         & F.xxhash64(docs[text_col]).eqNullSafe(which["h"]), "left_semi")

    # only rows that are repeated as a whole need to be thinned
    single, repeated = chosen(best.where("n = 1")), chosen(best.where("n > 1"))
    return single.unionByName(repeated.dropDuplicates([id_col, text_col]))
