"""Repeated word windows by recompression (operator 1).

Recompression rewrites a text in rounds.  A round names every maximal run of
one symbol and every pair of neighbouring runs whose left one lies on the left
and whose right one on the right side of a split of all symbols; the pair or
lone run becomes one symbol of the next round.  Names and sides are hashes of
what they stand for, so that all tasks name alike without a shared table.  A
symbol depends only on its context: its words and those of the neighbours that
fixed its borders.  Equal word sequences therefore have equal symbols wherever
the context lies inside (its interior symbols), and every window has some: in
the last resort its single words.

A window's anchor is its first interior symbol of the highest round, named
with its context.  A window can only be repeated if its anchor is, so blocks
first compare anchors (a fraction of the windows); then the windows of shared
anchors are verified by 128-bit names of all their words.  A window is removed
if its words also start in a document with a smaller id.

Defined results: a null text has no words; a null id is larger than any id and
two null ids are not compared; rows of equal id are no copies of each other;
texts shorter than a window stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.blocks import (ASK, Rolling, Words, answer, ask_rows, byte_views, for_blocks, groups, in_blocks,
                                 mix64, n_blocks, pieces, told, with_answers)

WINDOW = 13
ROUNDS = 4
_OUTSIDE = 1 << 40
U = np.uint64


class Symbols:
    """One round: names and contexts (first word, word after) of a text's symbols, in order."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray):
        self.name, self.low, self.high, self.text = name, low, high, text

    def next(self, round_: int) -> Symbols:
        n = len(self.name)
        if not n:
            return self
        new_text = np.concatenate([[True], self.text[1:] != self.text[:-1]])
        run = np.flatnonzero(new_text | np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        size = np.diff(np.append(run, n))
        base = self.name[run]
        name = np.where(size == 1, base, mix64(base + size.astype(U) * U(0xA24BAED4963EE407)))
        right = (mix64(base ^ U(0x9FB21C651E98DF25 + round_)) & U(1)).astype(bool)
        # a left run joins the right run after it in the same text
        joins = np.zeros(len(run), bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~new_text[run[1:]]
        joined = np.concatenate([[False], joins[:-1]])
        head = np.flatnonzero(~joined)
        pair = joins[head]
        out = name[head]
        out[pair] = mix64(name[head[pair]] * U(3) + mix64(name[head[pair] + 1] + U(round_)))
        first = run[head]
        last = np.append(first[1:], n) - 1
        # the neighbours decide where a symbol ends; at a text's edge nothing does
        low = np.where(new_text[first], -_OUTSIDE, self.low[np.maximum(first - 1, 0)])
        at_end = np.append(new_text[1:], True)[last]
        high = np.where(at_end, _OUTSIDE, self.high[np.minimum(last + 1, n - 1)])
        return Symbols(out, low, high, self.text[first])


class Windows:
    """The windows of some texts: their first words, anchors and (later) full names."""

    def __init__(self, words: Words, window: int):
        n = len(words)
        self.words, self.window = words, window
        self.text = words.doc()
        left = words.first[1:][self.text] - np.arange(n) if n else np.zeros(0, np.int64)
        self.start = np.flatnonzero(left >= window)
        self.name = words.names(1)
        self.rolling = Rolling(self.name)

    def anchors(self, rounds: int = ROUNDS) -> np.ndarray:
        """The anchor's name for each window."""
        at = np.arange(len(self.name))
        levels = [Symbols(self.name, at, at + 1, self.text)]
        for r in range(rounds):
            levels.append(levels[-1].next(r + 1))
        out = np.zeros(len(self.start), U)
        todo = np.arange(len(self.start))
        for r in range(rounds, -1, -1):
            s = levels[r]
            inner = np.flatnonzero((s.low >= 0) & (s.high < _OUTSIDE) & (s.high - s.low <= self.window))
            if not len(inner) or not len(todo):
                continue
            low, high = s.low[inner], s.high[inner]
            first = np.searchsorted(low, self.start[todo])
            ok = first < len(low)
            ok[ok] = high[first[ok]] <= self.start[todo[ok]] + self.window
            symbol = first[ok]
            key = mix64(self.rolling.of(low, high) + U(r))
            out[todo[ok]] = key[symbol]
            todo = todo[~ok]
        return out

    def names(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the words of some windows."""
        s = self.start[which]
        other = Rolling(self.words.names(2))
        return self.rolling.of(s, s + self.window), other.of(s, s + self.window)


def _parts(rows: pa.Table, window: int):
    """The windows of each piece of a block, with the piece's rows and ids."""
    data, offsets = byte_views(rows.column("text"))
    ids = rows.column("id").to_numpy()
    for i, j in pieces(offsets):
        w = Windows(Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), window)
        yield i, j, ids[i:j], w


def _distinct(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the smallest id of each, and whether it has several."""
    order = np.argsort(key, kind="stable")
    key, ids = key[order], ids[order]
    first = groups(key)
    if not len(first):
        return key, ids, np.zeros(0, bool)
    low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    return key[first], low, low != high


def _anchor_keys(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, ids = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, _, own, w in parts:
        a = w.anchors()
        text = w.text[w.start]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
        keys.append(a[new])
        ids.append(own[text[new]])
    return _distinct(np.concatenate(keys), np.concatenate(ids))


def _is_shared(columns, owner) -> np.ndarray:
    """Is a key in documents of at least two ids?"""
    key, low, several = columns
    order = np.argsort(key, kind="stable")
    first = groups(key[order])
    sizes = np.diff(np.append(first, len(key)))
    low_, several_ = low[order], several[order]
    yes = np.logical_or.reduceat(several_, first) | (np.minimum.reduceat(low_, first) != np.maximum.reduceat(low_, first))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(yes, sizes)
    return out


def _has_smaller(columns, owner) -> np.ndarray:
    """Does another block have the same 128-bit name in a document of smaller id?"""
    key, second, low = columns
    order = np.lexsort((second, key))
    k, s, ids = key[order], second[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(k))))
    out = np.empty(len(key), bool)
    out[order] = least < ids
    return out


class _Block:
    """What one block computes alike in every pass."""

    def __init__(self, rows: pa.Table, window: int, n_buckets: int):
        self.rows, self.window, self.n_buckets = rows, window, n_buckets

    def parts(self):
        return _parts(self.rows, self.window)

    def candidates(self, anchors: dict[int, bytes]):
        """For each piece its windows with a shared anchor; then all their names, distinct."""
        key, _, _ = _anchor_keys(self.parts())
        shared = key[told(key, self.n_buckets, anchors, bool)]
        found, h, g, ids = [], [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for i, j, own, w in self.parts():
            a = w.anchors()
            at = np.minimum(np.searchsorted(shared, a), max(0, len(shared) - 1))
            which = np.flatnonzero(shared[at] == a) if len(shared) else np.zeros(0, np.int64)
            x, y = w.names(which)
            doc = own[w.text[w.start[which]]]
            found.append((i, j, w.start[which], w.words.first, len(h[0])))
            h.append(x)
            g.append(y)
            ids.append(doc)
        sizes = [len(x) for x in h[1:]]
        h, g, ids = np.concatenate(h), np.concatenate(g), np.concatenate(ids)
        order = np.lexsort((g, h))
        hs, gs = h[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])])) if len(h) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(ids[order], first) if len(h) else ids
        name = np.empty(len(h), np.int64)
        name[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        return found, sizes, ids, name, hs[first], gs[first], low


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, no_id, n_words, n_removed, kept_sha256, kept) for every row of ``docs``."""
    n = n_blocks(docs)
    n_buckets = max(4, n // 3)
    blocks = in_blocks(docs, n, id_col, text_col)

    def ask_anchors(block: int, rows: pa.Table) -> pa.Table:
        return ask_rows(block, n_buckets, *_anchor_keys(_parts(rows, window)))

    anchors = answer(for_blocks(blocks, ask_anchors, ASK), [U, np.int64, bool], _is_shared)

    def ask_windows(block: int, rows: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        *_, h, g, low = _Block(rows, window, n_buckets).candidates(loads)
        return ask_rows(block, n_buckets, h, g, low)

    windows = answer(with_answers(blocks, anchors, ask_windows, ASK), [U, U, np.int64], _has_smaller)
    both = anchors.unionByName(windows.select("block", (F.col("bucket") + n_buckets).alias("bucket"), "load"))

    def remove(block: int, rows: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        b = _Block(rows, window, n_buckets)
        found, sizes, ids, name, h, g, low = b.candidates({k: v for k, v in loads.items() if k < n_buckets})
        smaller = told(h, n_buckets, {k - n_buckets: v for k, v in loads.items() if k >= n_buckets}, bool)
        gone = smaller[name] | (low[name] < ids) if len(ids) else np.zeros(0, bool)
        texts = rows.column("text")
        n_words, n_removed, digest = [], [], []
        at = 0
        for (i, j, start, first, _), size in zip(found, sizes, strict=True):
            cover = np.zeros(int(first[-1]) + 1, np.int64)
            begin = start[gone[at:at + size]]
            cover[begin] += 1
            np.add.at(cover, begin + window, -1)
            removed = np.cumsum(cover[:-1]) > 0
            at += size
            for t in range(j - i):
                x, y = int(first[t]), int(first[t + 1])
                words = texts[i + t].as_py().encode().split()
                cut = removed[x:y]
                n_cut = int(cut.sum())
                kept = compress(words, (~cut).tolist()) if n_cut else words
                n_words.append(y - x)
                n_removed.append(n_cut)
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"id": rows.column("id"), "no_id": rows.column("no_id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return with_answers(blocks, both, remove, "id long, no_id boolean, n_words long, n_removed long, kept_sha256 string")
