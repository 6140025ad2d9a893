"""Text scores from a log-frequency Bloom filter of bigram counts (operator 10).

Training counts every pair of neighbouring tokens (a text's words, then one
end; a text begins after an end).  A count c is quantised to q = 1 +
floor(log2 c), and the filter holds the pair once for each level 1 .. q, so
that probing level after level until one is absent gives q back: never less
than the stored level, and more only by a false positive of the filter.

The filter is cut by key into slices, each filled by the task that owns that
key range, with ``bits`` for each stored level at any size of the corpus.  The
slices stay a table: a block of documents sends its distinct pairs to the slices
that own them and gets a level back for each, so no task and not the driver ever
holds more than its slice.

A pair's probability is interpolated with the exact add-one unigram estimate:
lam 2^(q-1) / c(v) + (1 - lam) (c(w) + 1) / (N + V + 1), where lam =
(1 - u) c(v) / (c(v) + 1) and u, the share of the pairs seen once, is the
Good-Turing estimate of meeting a new pair.  2^(q-1) is no larger than the
count, so the sum over w stays within 1 but for false positives; a pair is only
probed if both its words were seen, and counts for no more than either of them.

Unigram counts are exact: each block of documents asks the buckets that own
its distinct words.

Defined results: a null or empty text is one end token; a null id counts as
the empty text (a training row); repeated rows count each time; with no
training rows N and V are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.blocks import (ANSWER, ASK, Words, answer, ask_rows, bucket_bounds, byte_views, for_blocks, groups,
                                 in_blocks, mix64, n_blocks, packed, pieces, told, unpacked, with_answers)
from casework.session import materialize

U = np.uint64
END = U(0x5851F42D4C957F2D)
BITS = 8
PROBES = 4
#: above the level of any count
MOST = 63
#: distinct pairs a task holds before it sends them
_HELD = 1 << 20


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


class Tokens:
    """The token names of some texts: words in lower case, then one end each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True)
        n = len(offsets) - 1
        self.first = words.first + np.arange(n + 1)      # of each text's first token
        self.name = np.full(len(words) + n, END, U)
        self.name[np.arange(len(words)) + words.doc()] = words.names(5)
        self.text = np.repeat(np.arange(n), np.diff(self.first))

    def before(self) -> np.ndarray:
        """The token before each; the first one follows an end."""
        out = np.concatenate([[END], self.name[:-1]])
        out[self.first[:-1]] = END
        return out

    def pairs(self) -> np.ndarray:
        return mix64(self.before() * U(0x9E3779B97F4A7C15) + mix64(self.name))


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
        first = groups(keys)
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = groups(keys)
    return keys[first], np.add.reduceat(counts, first).astype(np.int64) if len(first) else counts.astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _place(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mix64(keys + U((level * 64 + probe + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))


def _short(keys: np.ndarray) -> np.ndarray:
    """The 48 leading bits, by which the filter knows a pair."""
    return keys & U(0xFFFFFFFFFFFF0000)


def fill(keys: np.ndarray, counts: np.ndarray, bits: float, probes: int, max_bytes: int | None = None) -> np.ndarray:
    """A filter slice, as bytes, that holds each key at every level up to its
    own; it grows with the keys unless a caller bounds it."""
    q = levels(counts)
    size = max(64, q.sum() * bits)
    size = int(size if max_bytes is None else min(size, 8 * max_bytes)) // 64 * 64
    out = np.zeros(size, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        own = keys[q >= level]
        for p in range(probes):
            out[(_place(own, level, p) % U(size)).astype(np.int64)] = True
    return np.packbits(out)


class CountFilter:
    """Some slices, end to end."""

    def __init__(self, slices: list[bytes], probes: int, once: float):
        self.probes, self.once = probes, once
        self.size = np.array([8 * len(s) for s in slices], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(slices), np.uint8)

    def level(self, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The level each key is held at (0: absent), at most ``most``."""
        keys = _short(keys)
        out = np.zeros(len(keys), np.int64)
        edges = (np.arange(1, len(self.size), dtype=object) * 2**64 // len(self.size)).astype(U)
        part = np.searchsorted(edges, keys, "right")
        size, at = self.size[part].astype(U), self.at[part]
        live, level = np.flatnonzero(most > 0), 1
        while len(live):
            for p in range(self.probes):
                place = _place(keys[live], level, p)
                bit = at[live] + (place % size[live]).astype(np.int64)
                live = live[(self.data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)]
            out[live] = level
            level += 1
            live = live[most[live] >= level]
        return out


def train_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS,
                 probes: int = PROBES) -> DataFrame:
    """The filter of all pairs in training rows: (bucket, part, once, n), a row
    for each slice with any pair, its pairs seen once and all it counted."""
    n_buckets = max(4, n_blocks(docs) // 3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held):
            keys, counts = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = bucket_bounds(keys, n_buckets)
            high, low = (keys >> U(32)).astype(np.uint32), (keys >> U(16)).astype(np.uint16)
            rows = [(b, packed(high[i:j], low[i:j], counts[i:j].astype(np.uint32)))
                    for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                              ["bucket", "load"])
        held, n = [], 0
        for b in batches:
            data, offsets = byte_views(b.column(0))
            for i, j in pieces(offsets):
                keys, counts = _counted(_short(Tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]).pairs()))
                held.append((keys, counts))
                n += len(keys)
                if n > _HELD:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    def build(table: pa.Table) -> pa.Table:
        loads = [unpacked(x.as_py(), np.uint32, np.uint16, np.uint32) for x in table.column("load")]
        keys = np.concatenate([(h.astype(U) << U(32)) | (m.astype(U) << U(16)) for h, m, _ in loads])
        keys, counts = _counted(keys, np.concatenate([c for *_, c in loads]).astype(np.int64))
        part = fill(keys, counts, bits, probes)
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()).combine_chunks(), "part": pa.array([part.tobytes()], pa.binary()),
                         "once": pa.array([int((counts == 1).sum())], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64())})

    texts = docs.where(~held_out(id_col)).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.mapInArrow(count, "bucket int, load binary").groupBy("bucket").applyInArrow(build, "bucket int, part binary, once long, n long")


_SCORES = ("id long, no_id boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def _sum_counts(columns, owner) -> np.ndarray:
    """The sum of all blocks' counts of each key."""
    key, count = columns
    order = np.argsort(key, kind="stable")
    first = groups(key[order])
    sums = np.add.reduceat(count[order].astype(np.int64), first)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(first, len(key))))
    return out


def probe(asked: DataFrame, slices: DataFrame, probes: int) -> DataFrame:
    """Ask the slices: one level (a byte) for each pair of a block's question."""
    def run(asked: pa.Table, mine: pa.Table) -> pa.Table:
        part = mine.column("part")[0].as_py() if mine.num_rows else bytes(8)
        own = CountFilter([part], probes, 0)
        back = []
        for x in asked.column("load"):
            keys = unpacked(x.as_py(), U)[0]
            back.append(own.level(keys, np.full(len(keys), MOST)).astype(np.uint8).tobytes())
        return pa.table({"block": asked.column("block").cast(pa.int32()), "bucket": asked.column("bucket").cast(pa.int32()),
                         "load": pa.array(back, pa.binary())})
    return asked.groupBy("bucket").cogroup(slices.groupBy("bucket")).applyInArrow(run, ANSWER)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS, probes: int = PROBES) -> DataFrame:
    """Every row's token figures, its unigram score and its model score (log10)."""
    slices = materialize(train_filter(docs, id_col, text_col, bits, probes))
    seen = slices.agg(F.sum("once").alias("once"), F.sum("n").alias("n")).first()
    once = (seen["once"] or 0) / max(1, seen["n"] or 0)
    n = n_blocks(docs)
    n_buckets = max(4, n // 3)
    blocks = in_blocks(docs.withColumn("_held", held_out(id_col)), n, id_col, text_col, F.col("_held").alias("held"))

    def parts(rows: pa.Table):
        data, offsets = byte_views(rows.column("text"))
        held = rows.column("held").to_numpy(zero_copy_only=False)
        for i, j in pieces(offsets):
            yield i, j, held[i:j], Tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])

    def words_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct words, and how often they occur in its training rows."""
        found = [(np.array([END]), np.zeros(1, np.int64))]
        for _, _, held, t in parts(rows):
            keys, back = np.unique(t.name, return_inverse=True)
            found.append((keys, np.bincount(back, weights=~held[t.text], minlength=len(keys)).astype(np.int64)))
        return _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def ask(block: int, rows: pa.Table) -> pa.Table:
        keys, counts = words_of(rows)
        return ask_rows(block, n_buckets, keys, counts.astype(np.uint32))

    def pairs_of(rows: pa.Table) -> np.ndarray:
        """The block's distinct pairs, as the filter knows them."""
        found = [np.unique(_short(t.pairs())) for *_, t in parts(rows)]
        return np.unique(np.concatenate([np.zeros(0, U), *found]))

    def ask_pairs(block: int, rows: pa.Table) -> pa.Table:
        return ask_rows(block, n_buckets, pairs_of(rows))

    asked = for_blocks(blocks, ask, ASK)
    counts = answer(asked, [U, np.uint32], _sum_counts)
    # the buckets of pairs are numbered after those of words
    held_at = probe(for_blocks(blocks, ask_pairs, ASK), slices.select("bucket", "part"), probes).withColumn("bucket", F.col("bucket") + n_buckets)

    def size(table: pa.Table) -> pa.Table:
        loads = [unpacked(x.as_py(), U, np.uint32) for x in table.column("load")]
        _, c = _counted(np.concatenate([x for x, _ in loads]), np.concatenate([y for _, y in loads]).astype(np.int64))
        return pa.table({"n": pa.array([int(c.sum())], pa.int64()), "v": pa.array([int((c > 0).sum())], pa.int64())})

    # one row, for every block: N and V
    totals = (asked.groupBy("bucket").applyInArrow(size, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
              .select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(-1).alias("bucket"),
                      F.concat(F.lit("N "), "n", F.lit(" "), "v").cast("binary").alias("load")))

    def rate(block: int, rows: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        total, distinct = map(int, loads.pop(-1).decode().split()[1:])
        out = [[] for _ in range(4)]
        keys, _ = words_of(rows)
        counts = told(keys, n_buckets, loads, np.int64) if rows.num_rows else np.zeros(len(keys), np.int64)
        end = int(counts[np.searchsorted(keys, END)])
        pairs = pairs_of(rows)
        held_level = told(pairs, n_buckets, {b - n_buckets: x for b, x in loads.items()}, np.uint8)
        for _, _, _, t in parts(rows):
            c = counts[np.searchsorted(keys, t.name)]
            before = np.concatenate([[0], c[:-1]])
            before[t.first[:-1]] = end
            one = (c + 1) / (total + distinct + 1)
            q = held_level[np.searchsorted(pairs, _short(t.pairs()))].astype(np.int64)
            q = np.minimum(q, levels(np.minimum(c, before)) * ((c > 0) & (before > 0)))
            lam = (1 - once) * before / (before + 1)
            two = np.where(q > 0, np.exp2(q - 1.0) / np.maximum(before, 1), 0)
            both = lam * np.minimum(two, 1) + (1 - lam) * one
            first = t.first[:-1]
            out[0].append(np.diff(t.first))
            out[1].append(np.add.reduceat((c > 0).astype(np.int64), first))
            out[2].append(np.add.reduceat(np.log10(one), first))
            out[3].append(np.add.reduceat(np.log10(both), first))
        n_tokens, n_known, base, model = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"id": rows.column("id"), "no_id": rows.column("no_id"), "held_out": rows.column("held"),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "train_tokens": pa.array(np.full(rows.num_rows, total), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(model, pa.float64())})

    return with_answers(blocks, counts.unionByName(held_at).unionByName(totals), rate, _SCORES)
