"""Benchmark decontamination by latent semantic retrieval (operator 3).

Documents are read as sequences of benchmark terms (a word that no benchmark
item has can neither raise a cosine with an item nor lengthen a common
subsequence).  Passages of ``stride`` words give document frequencies and a
TF-IDF matrix; its leading right singular vectors come from a randomised range
finder with one power step, each step a distributed pass that sums
``A' (A Q)`` (terms x rank, bounded by the benchmark).  A passage has few terms, so
a task first sums the products of its pairs of terms, and multiplies by Q once
(where the pairs of all terms are too many to hold, passage by passage).  The document frequencies
count all passages, and the singular vectors are fitted to the items and all
passages, each text once (``basis_passages``, if set, bounds them: the texts of
smallest hash).  Overlapping passages of
twice that length, of every text, are folded into the latent space and compared
with all items; every term counts, by its IDF.  A pair whose cosine reaches ``cosine``
(less for an item shorter than a passage, whose other words lower it) is checked
on the words themselves: the longest common subsequence must hold ``overlap`` of the item's
words, and ``answer`` of the words of its answer (the item's last sentence; of
an item of one sentence the last third).

The benchmark is the small side: it is broadcast in parts of at most
``part_items`` items, each with its own space, so a larger benchmark takes more
passes, not more memory.

Defined results: null texts and items have no words and match nothing; null
ids keep their rows; an item with fewer than ``min_words`` words is found where
all of them stand in a row (cosine, overlap and answer 1); repeated rows share
one result; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.blocks import byte_views, groups, pieces
from casework.llm.terms import Terms
from casework.session import materialize

U = np.uint64
#: items compared together
_ITEMS = 256
#: a frequent word is in more than one of so many passages
_FREQUENT = 16
#: sums of all pairs of terms are held in a task up to so many bytes
_PAIR_BYTES = 128 << 20
#: encoded text for a task that sums passages: each sends a matrix of terms x rank
_TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Settings:
    stride: int = 16
    rank: int = 192
    spare: int = 12
    cosine: float = 0.4
    overlap: float = 0.6
    answer: float = 0.6
    min_words: int = 5
    part_items: int = 5_000
    basis_passages: int | None = None
    seed: int = 11


@dataclass
class Item:
    key: int | None
    words: np.ndarray          # term numbers in order
    answer: int                # words of the answer, at the end
    masks: dict                # term -> bits of its places
    tail: dict                 # the same of the answer alone


def _answer_words(text: str) -> int:
    """Words in the last sentence, or in the last third of a single one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if len(Terms.of([s])) > 0]
    n = len(Terms.of([text]))
    if len(sentences) > 1:
        return max(1, len(Terms.of([sentences[-1]])))
    return max(1, -(-n // 3))


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """The last row of the table of common subsequences of an item (``masks``:
    word -> bits of its places) and ``words``, as bits: 0 where it grows by one."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            x = row & m
            row = ((row + x) | (row - x)) & full
    return row


def _length(row: int, n: int) -> int:
    return n - row.bit_count()


class Matcher:
    """The items of one part, broadcast to all tasks."""

    def __init__(self, rows: list[tuple], settings: Settings):
        self.settings = settings
        names = [Terms.of([t or ""]).names() for _, t in rows]
        self.vocab = np.unique(np.concatenate([np.zeros(0, U), *names]))
        self.items: list[Item] = []
        self.short: dict[int, dict[tuple, list]] = {}    # by length: words -> keys of the items
        for (key, text), own in zip(rows, names, strict=True):
            words = np.searchsorted(self.vocab, own)
            if len(own) < settings.min_words:
                if len(own):
                    self.short.setdefault(len(own), {}).setdefault(tuple(words.tolist()), []).append(key)
                continue
            masks: dict[int, int] = {}
            for i, w in enumerate(words.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            rest = len(words) - _answer_words(text)
            tail = {w: m >> rest for w, m in masks.items() if m >> rest}
            self.items.append(Item(key, words, len(words) - rest, masks, tail))
        self.idf = np.ones(len(self.vocab), np.float32)
        self.basis: np.ndarray | None = None
        self.latent: np.ndarray | None = None

    def encode(self, names: np.ndarray) -> np.ndarray:
        """Term numbers; -1 for words that no item has."""
        if not len(self.vocab):
            return np.full(len(names), -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocab, names), len(self.vocab) - 1)
        return np.where(self.vocab[at] == names, at, -1).astype(np.int32)

    def set_idf(self, df: np.ndarray, passages: int) -> None:
        """Weights from passages; every term has one.

        An item cannot be found where too few of its rarer words are, even if
        all its frequent words were there: ``rare_least`` of them are needed
        within ``reach`` strides of the passage."""
        self.idf = np.log((2 + passages) / (1 + df)).astype(np.float32)
        self.frequent = df * _FREQUENT > passages
        n = np.array([len(x.words) for x in self.items], np.int64)
        common = np.array([self.frequent[x.words].sum() for x in self.items], np.int64)
        self.rare_least = self.settings.overlap * n - common - 1e-9
        self.reach = -(-n // self.settings.stride)

    def fold(self, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent unit vectors of the passages (two strides long) that have any
        term.  A passage is the sum of its strides, so each word is added once;
        its TF-IDF length falls out with the length of the vector."""
        stride = self.settings.stride
        at = np.flatnonzero(terms >= 0)
        text = np.searchsorted(offsets, at, "right") - 1
        base = passage_base(offsets, stride)
        key = base[text] + (at - offsets[text]) // stride
        z = np.zeros((int(base[-1]), self.basis.shape[1]), np.float32)
        if len(at):
            first = groups(key)
            turn = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            for k in range(stride):                      # the k-th words of all strides
                own = np.flatnonzero(turn == k)
                z[key[own]] += self.scaled[terms[at[own]]]
            more = np.ones(len(z), bool)
            more[base[1:][base[1:] > 0] - 1] = False     # a text's last passage
            more = np.flatnonzero(more)
            z[more] += z[more + 1]                       # the right side is read before any is added
        norm = np.linalg.norm(z, axis=1)
        some = np.flatnonzero(norm > 1e-9)
        return some, z[some] / norm[some, None]

    def set_basis(self, basis: np.ndarray) -> None:
        self.basis = np.ascontiguousarray(basis, np.float32)
        self.scaled = self.basis * self.idf[:, None]
        rows = []
        for item in self.items:
            _, t, w = weigh(item.words, [0, len(item.words)], self.idf, len(item.words), 1)
            z = (self.basis[t] * w[:, None]).sum(axis=0) if len(t) else np.zeros(self.basis.shape[1], np.float32)
            rows.append(z / max(np.linalg.norm(z), 1e-9))
        self.latent = np.array(rows, np.float32).reshape(len(self.items), self.basis.shape[1])
        # the words around an item shorter than a passage lower its cosine
        length = np.array([len(item.words) for item in self.items])
        self.least = (self.settings.cosine * np.sqrt(np.minimum(1, length / (2 * self.settings.stride)))).astype(np.float32)

    def exact(self, terms: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """Like ``search``, the items under ``min_words`` words: their first place in each text."""
        found: dict[tuple, int] = {}
        for n, items in self.short.items():
            if len(terms) < n:
                continue
            text = np.searchsorted(offsets, np.arange(len(terms) - n + 1), "right") - 1
            begins = np.isin(terms[:len(terms) - n + 1], [w[0] for w in items]) & (np.arange(len(text)) + n <= offsets[text + 1])
            for i in np.flatnonzero(begins).tolist():
                for key in items.get(tuple(terms[i:i + n].tolist()), ()):
                    found.setdefault((int(text[i]), key), i - int(offsets[text[i]]))
        return [(t, key, at, 1.0, 1.0, 1.0) for (t, key), at in found.items()]

    def search(self, terms: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(text, item, first word, cosine, share of the item, share of its
        answer), the best place for each text and item."""
        s = self.settings
        if not self.items:
            return []
        best: dict[tuple, tuple] = {}
        base = passage_base(offsets, s.stride)
        passage, z = self.fold(terms, offsets)
        strides = np.diff(base)
        text = np.repeat(np.arange(len(strides)), strides)[passage]
        turn = passage - base[text]
        rows = self.stride_terms(terms, offsets, base)
        for j0 in range(0, len(self.items), _ITEMS):
            block = self.items[j0:j0 + _ITEMS]
            upto = self.rare_upto(block, rows)
            for at in range(0, len(passage), 1 << 12):
                mine = slice(at, at + (1 << 12))
                cos = z[mine] @ self.latent[j0:j0 + _ITEMS].T
                which, own = np.divmod(np.flatnonzero(cos >= self.least[j0:j0 + _ITEMS]), len(block))
                own_text, own_turn, reach = text[mine][which], turn[mine][which], self.reach[j0 + own]
                low = base[own_text] + np.maximum(own_turn - reach, 0)
                high = base[own_text] + np.minimum(own_turn + 2 + reach, strides[own_text])
                enough = upto[high, own] - upto[low, own] >= self.rare_least[j0 + own]
                for w, o in zip(which[enough].tolist(), own[enough].tolist(), strict=True):
                    self._compare(best, j0 + o, int(text[at + w]), int(turn[at + w]) * s.stride, float(cos[w, o]), terms, offsets)
        return [(t, self.items[j].key, -f[2], f[1], f[0], f[3]) for (t, j), f in sorted(best.items())]

    def stride_terms(self, terms: np.ndarray, offsets: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The terms of every stride, one row each; the number of terms where there is none."""
        rows = np.full((int(base[-1]), self.settings.stride), len(self.vocab), np.int32)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.arange(len(terms)) - offsets[text]
        rows[base[text] + at // self.settings.stride, at % self.settings.stride] = np.where(terms < 0, len(self.vocab), terms)
        return rows

    def rare_upto(self, block: list[Item], rows: np.ndarray) -> np.ndarray:
        """How many places of rarer words of each item come before each stride."""
        has = np.zeros((len(self.vocab) + 1, len(block)), np.uint8)
        for o, item in enumerate(block):
            has[item.words, o] = 1
        has[:-1][self.frequent] = 0
        count = np.zeros((len(rows), len(block)), np.uint8)
        for k in range(rows.shape[1]):
            count += has[rows[:, k]]
        return np.concatenate([np.zeros((1, len(block)), np.int32), np.cumsum(count, axis=0, dtype=np.int32)])

    def _compare(self, best: dict, j: int, text: int, first: int, cos: float, terms: np.ndarray, offsets: np.ndarray) -> None:
        """The item's and its answer's longest common subsequences with the words around a passage."""
        s, item = self.settings, self.items[j]
        n = len(item.words)
        begin, end = offsets[text] + max(0, first - n), min(offsets[text + 1], offsets[text] + first + 2 * s.stride + n)
        words = [w for w in terms[begin:end].tolist() if w in item.masks]
        # no more words can be common than are in both
        if len(words) < s.overlap * n or len(set(words)) + n - len(item.masks) < s.overlap * n:
            return
        share = _length(common_subsequence(item.masks, n, words), n) / n
        if share < s.overlap:
            return
        got = _length(common_subsequence(item.tail, item.answer, words), item.answer) / item.answer
        if got < s.answer:
            return
        found = (share, cos, -first, got)
        if found > best.get((text, j), (0,)):
            best[text, j] = found


def passage_base(offsets: np.ndarray, stride: int) -> np.ndarray:
    """The number of the first passage of each text, and of all passages."""
    return np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // stride))])


def weigh(terms: np.ndarray, offsets, idf: np.ndarray, stride: int, strides: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows (passage, term, weight) of the passages of some texts,
    one beginning at every ``stride`` words and ``strides`` long."""
    offsets = np.asarray(offsets)
    at = np.flatnonzero(terms >= 0)
    at = at[idf[terms[at]] > 0]
    term = terms[at].astype(np.int64)
    text = np.searchsorted(offsets, at, "right") - 1
    base = passage_base(offsets, stride)[text]
    last = (at - offsets[text]) // stride
    passage = np.concatenate([base + last - k for k in range(strides)])
    inside = np.concatenate([last >= k for k in range(strides)])
    key = (passage * len(idf) + np.tile(term, strides))[inside]
    key, count = np.unique(key, return_counts=True)
    passage, term = key // len(idf), key % len(idf)
    weight = (idf[term] * count).astype(np.float32)
    if len(key):
        first = groups(passage)
        norm = np.sqrt(np.add.reduceat(weight.astype(np.float64) ** 2, first))
        weight /= np.repeat(norm, np.diff(np.append(first, len(key)))).astype(np.float32)
    return passage, term, weight


_ENCODED = "id long, h long, terms binary"


def encode(docs: DataFrame, matcher, id_col: str, text_col: str) -> DataFrame:
    """Every text as the numbers of its benchmark terms (int32, -1: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for b in batches:
            data, offsets = byte_views(b.column(2))
            for i, j in pieces(offsets):
                words = Terms(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                terms = m.encode(words.names())
                loads = [terms[x:y].astype(np.int32).tobytes() for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(loads, pa.binary())], ["id", "h", "terms"])
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"),
                       F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, _ENCODED)


def _texts(loads: pa.Array, most: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` words: the first one's place, all terms, offsets."""
    data, offsets = byte_views(loads)
    offsets = offsets // 4
    for i, j in pieces(offsets, most):
        yield i, np.frombuffer(data[4 * offsets[i]:4 * offsets[j]].tobytes(), np.int32), offsets[i:j + 1] - offsets[i]


def document_frequencies(encoded: DataFrame, n_terms: int, stride: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages (counted as term ``n_terms``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 1, np.int64)
        for b in batches:
            for _, terms, offsets in _texts(b.column(0)):
                at = np.flatnonzero(terms >= 0)
                text = np.searchsorted(offsets, at, "right") - 1
                base = passage_base(offsets, stride)
                key = np.unique((base[text] + (at - offsets[text]) // stride) * n_terms + terms[at])
                df[:n_terms] += np.bincount(key % n_terms, minlength=n_terms)
                df[n_terms] += base[-1]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "n"])
    # one row for each benchmark term
    rows = (encoded.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(n_terms + 1, np.int64)
    df[rows["term"]] = rows["n"]
    return df[:n_terms], int(df[n_terms])


_SLICE = 256


def add_pairs(sums: np.ndarray, passage: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
    """Add the products of the weights of all pairs of terms of each passage
    (sorted by passage and term) to the lower triangle ``sums``, row by row;
    the diagonal is halved, so that triangle + transpose is ``A' A``."""
    weight = weight.astype(np.float64)
    np.add.at(sums, term * (term + 1) // 2 + term, weight * weight / 2)
    first = np.arange(len(term))
    for k in range(1, len(term)):                        # the k-th next term of the same passage
        first = first[first < len(term) - k]
        first = first[passage[first] == passage[first + k]]
        if not len(first):
            break
        high = term[first + k]
        np.add.at(sums, high * (high + 1) // 2 + term[first], weight[first] * weight[first + k])


def pairs_times(sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``A' (A q)`` from the sums of ``add_pairs``."""
    n, out = len(q), np.zeros(q.shape)
    for i in range(0, n, _SLICE):
        j = min(n, i + _SLICE)
        rows = np.zeros((j - i, j))
        for r in range(i, j):
            rows[r - i, :r + 1] = sums[r * (r + 1) // 2:(r + 1) * (r + 2) // 2]
        out[i:j] += rows @ q[:j]
        out[:j] += rows.T @ q[i:j]
    return out


def add_rows(out: np.ndarray, passage: np.ndarray, term: np.ndarray, weight: np.ndarray, q: np.ndarray, stride: int) -> None:
    """Add ``A' (A q)`` of some passages to ``out``."""
    first = groups(passage)
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(passage))))
    turn, y = np.arange(len(row)) - first[row], np.zeros((len(first), q.shape[1]), np.float32)
    for k in range(stride):                              # the k-th terms of all passages
        mine = np.flatnonzero(turn == k)
        y[row[mine]] += q[term[mine]] * weight[mine, None]
    order = np.argsort(term, kind="stable")
    at = groups(term[order])
    out[term[order][at]] += np.add.reduceat(y[row[order]] * weight[order, None], at, axis=0)


def gram_times(encoded: DataFrame, idf: np.ndarray, q: np.ndarray, stride: int) -> np.ndarray:
    """``A' (A q)`` over all passages: each task sums its rows into a matrix of
    terms x rank; slices of these matrices are added up, one task a slice."""
    sent = encoded.sparkSession.sparkContext.broadcast((idf, q.astype(np.float32)))
    n, width = q.shape
    pairs = 4 * n * (n + 1) <= _PAIR_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, omega = sent.value
        out = np.zeros(n * (n + 1) // 2) if pairs else np.zeros((n, width))
        for b in batches:
            for _, terms, offsets in _texts(b.column(0)):
                passage, term, weight = weigh(terms, offsets, weights, stride, 1)
                if not len(term):
                    continue
                if pairs:
                    add_pairs(out, passage, term, weight)
                else:
                    add_rows(out, passage, term, weight, omega, stride)
        if pairs:
            out = pairs_times(out, omega)
        cuts = range(0, n, _SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int64()),
                                          pa.array([out[i:i + _SLICE].astype(np.float32).tobytes() for i in cuts], pa.binary())], ["at", "m"])

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("m"))
        return pa.table({"at": table.column("at")[:1].combine_chunks(), "m": pa.array([sums.tobytes()], pa.binary())})

    parts = (encoded.select("terms").mapInArrow(run, "at long, m binary")
             .groupBy("at").applyInArrow(total, "at long, m binary").toPandas().sort_values("at"))
    if not len(parts):
        return np.zeros((n, width))
    # terms x rank: bounded by the part of the benchmark
    return np.concatenate([np.frombuffer(m, np.float64) for m in parts["m"]]).reshape(n, width)


def items_times(items: list[np.ndarray], idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``B' (B q)`` over the items' TF-IDF rows, some items at a time."""
    out = np.zeros(q.shape)
    for i in range(0, len(items), 256):
        part = items[i:i + 256]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in part])])
        row, term, weight = weigh(np.concatenate(part), offsets, idf, max(map(len, part)), 1)
        first = groups(row)
        y = np.add.reduceat(q[term] * weight[:, None], first, axis=0)
        y = np.repeat(y, np.diff(np.append(first, len(row))), axis=0) * weight[:, None]
        order = np.argsort(term, kind="stable")
        at = groups(term[order])
        out[term[order][at]] += np.add.reduceat(y[order], at, axis=0)
    return out


def latent_basis(encoded: DataFrame, idf: np.ndarray, items: list[np.ndarray], s: Settings) -> np.ndarray:
    """The leading right singular vectors of the passages' and items' TF-IDF rows."""
    n = len(idf)
    rank = min(s.rank, n)
    q = np.random.default_rng(s.seed).standard_normal((n, min(n, rank + s.spare)))
    q = np.linalg.qr(gram_times(encoded, idf, q, s.stride) + items_times(items, idf, q))[0]
    small = q.T @ (gram_times(encoded, idf, q, s.stride) + items_times(items, idf, q))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def hits(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, h, item_id, first_word, cosine, overlap, answer): each benchmark
    item found in a row of ``docs`` (h: hash of its text)."""
    spark, out = docs.sparkSession, None
    n_parts = max(1, -(-benchmark.count() // settings.part_items))
    for part in range(n_parts):
        mine = benchmark.select(item_col, item_text_col).where(
            F.pmod(F.xxhash64(item_col, item_text_col), F.lit(n_parts)) == part)
        # at most about part_items items
        matcher = Matcher([tuple(r) for r in mine.orderBy(item_col, item_text_col).collect()], settings)
        found = _hits(docs, matcher, settings, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def _hits(docs: DataFrame, matcher: Matcher, s: Settings, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    encoded = materialize(encode(docs, spark.sparkContext.broadcast(matcher), id_col, text_col))
    if matcher.items:
        df, passages = document_frequencies(encoded, len(matcher.vocab), s.stride)
        matcher.set_idf(df, passages)
        # the basis comes from every text, each once
        share = 1.0 if s.basis_passages is None else min(1.0, s.basis_passages / max(1, passages))
        rows = materialize(encoded.where(F.col("h").cast("double") <= share * 2.0**64 - 2.0**63).select("h", "terms").dropDuplicates(["h"]))
        # a task sends as much for few texts as for many, so each takes its share, however many parts the table has
        tasks = max(spark.sparkContext.defaultParallelism, -(-4 * s.stride * passages // _TASK_BYTES))
        matcher.set_basis(latent_basis(rows.coalesce(tasks), matcher.idf, [x.words for x in matcher.items], s))
    ready = spark.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready.value
        for b in batches:
            ids, hashes, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, terms, offsets in _texts(b.column(2), 1 << 14) if m.items or m.short else []:
                rows += [(ids[i + t], hashes[i + t], *found) for t, *found in m.search(terms, offsets) + m.exact(terms, offsets)]
            kinds = [pa.int64()] * 4 + [pa.float64()] * 3
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             ["id", "h", "item_id", "first_word", "cosine", "overlap", "answer"])

    return encoded.mapInArrow(run, "id long, h long, item_id long, first_word long, cosine double, overlap double, answer double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    found = materialize(hits(docs, benchmark, settings, id_col, text_col).select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct())
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_id"])
                     & (F.xxhash64(docs[text_col]) == found["_h"]), "left_anti")
