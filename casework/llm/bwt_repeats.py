"""Repeated byte strings by interval expansion on a Burrows-Wheeler transform (operator 2).

A string of ``length`` bytes that occurs twice must be found twice in one
place, so the texts are cut into overlapping contexts that are dealt by
content: every string of that length has a smallest hash among its 16-byte
grams, and neighbouring strings with the same smallest gram make one context.
Blocks first compare these grams; only contexts whose gram occurs in two
documents travel to the task that owns the gram.  A gram with very many
contexts is cut up: there every string is a context of its own, dealt by its
own name, so that no task gathers what shares a frequent gram.

There equal contexts are merged, the others laid end to end and suffix sorted,
and the borders between suffixes found breadth first by increasing common
prefix: rows whose first bytes differ have a common prefix of 0; a border of
value v between two rows becomes, one byte further left on the transform, a
border of value v + 1.  After ``length`` - 1 rounds the expansion stops: rows
without a border between them share ``length`` bytes, and each such interval
tells the smallest document that has its string.

Defined results: a null text is an empty one; matches never cross rows; a null
id is larger than any id and two null ids are not compared; rows of equal id
are no copies of each other; texts shorter than ``length`` stay whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.blocks import (ANSWER, ASK, Rolling, answer, ask_rows, bucket_bounds, byte_views, for_blocks, groups,
                                 in_blocks, mix64, n_blocks, numbers, packed, pieces, told, unpacked, with_answers)
from casework.llm.recompress import _distinct, _is_shared

LENGTH = 50
GRAM = 16
#: bytes of contexts sorted at once; one gram's contexts stay together
SHARD_BYTES = 1 << 17
#: texts are cut into runs in pieces of about so many bytes, which stay in a core's cache
RUN_BYTES = 1 << 17
#: a gram in more contexts is cut up: each string goes by its own name instead
HOT_CONTEXTS = 30_000
_HOT = 2
_MARK = 0xFF  # in no UTF-8 text
U = np.uint64


def _rolling(data: np.ndarray, seed: int) -> Rolling:
    return Rolling(numbers(seed, 256)[data])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The strings of ``length`` bytes of some texts as runs of equal smallest
    gram: gram, first byte, how many strings, text."""
    n, sizes = len(data), np.diff(offsets)
    if n < length:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U), empty, empty, empty
    roll = _rolling(data, 9)
    low = mix64((roll.sums[gram:] - roll.sums[:-gram]) * roll.down[:n - gram + 1])
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(low)]
    start = np.flatnonzero(offsets[1:][text] - np.arange(len(low)) >= length)
    key, text = low[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    # scrambled, for smallest hashes crowd at one end of their range
    return mix64(key[first] + U(1)), start[first], np.diff(np.append(first, len(start))), text[first]


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. for size[0] numbers, then the same of the next."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` bytes: eight at first,
    then the known order of what follows doubles the depth where rows still tie."""
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("a shard of contexts must stay below 2 GB")
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, U)
    for j in range(8):
        key <<= U(8)
        key |= padded[j:j + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    first = groups(key)
    size = np.diff(np.append(first, n))
    del key, padded
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first.astype(np.int32), size)
    rows = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)
    done = 8
    while done < depth and len(rows):
        at = order[rows]
        after = at + done
        key = rank[at].astype(np.int64) << 32
        key |= np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[rows] = at
        first = groups(key)
        size = np.diff(np.append(first, len(key)))
        rank[at] = np.repeat(rows[first], size)
        rows = rows[np.repeat(size > 1, size)]
        done *= 2
    return order


def interval_borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a row shares fewer than ``length`` bytes with the row above."""
    n = len(text)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    letter = text[order]
    border = np.ones(n, bool)
    border[1:] = letter[1:] != letter[:-1]
    # the row one byte to the right; the last suffix has none and stays alone
    right = row[np.minimum(order + 1, n - 1)]
    end = row[n - 1]
    border[end:end + 2] = True
    del row, letter
    open_ = np.flatnonzero(~border).astype(np.int32)
    low, high = right[open_ - 1], right[open_]
    del right
    low, high = np.minimum(low, high), np.maximum(low, high)
    for _ in range(1, length):  # rows whose common prefix is this value, for 1, 2, ..
        seen = np.cumsum(border, dtype=np.int32)
        hit = seen[low] != seen[high]
        if not hit.any():
            break
        border[open_[hit]] = True
        rest = ~hit
        open_, low, high = open_[rest], low[rest], high[rest]
    return border


def smallest_owner(contexts: list[bytes], owner: np.ndarray, length: int) -> np.ndarray:
    """For every string of each context, end to end, the smallest owner of a context that has it."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    order = suffix_order(text, length)
    first = np.flatnonzero(interval_borders(text, order, length))
    strings = sizes - length + 1
    at = _expand(np.cumsum(sizes + 1) - (sizes + 1), strings)
    whose = np.full(len(text), np.iinfo(np.int64).max)
    whose[at] = np.repeat(owner, strings)
    least = np.minimum.reduceat(whose[order], first)
    whose[order] = np.repeat(least, np.diff(np.append(first, len(text))))
    return whose[at]


def _load(key: np.ndarray, size: np.ndarray, low: np.ndarray, body: bytes) -> bytes:
    return np.int64(len(key)).tobytes() + packed(key, size.astype(np.int32), low) + body


def _unload(load: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(load, np.int64, 1)[0])
    key, size, low = unpacked(load, U, np.int32, np.int64, n=n, at=8)
    return key, size, low, load[8 + 20 * n:]


class _Block:
    """What one block computes alike in every pass."""

    def __init__(self, rows: pa.Table, length: int, gram: int, n_buckets: int):
        self.data, self.offsets = byte_views(rows.column("text"))
        self.ids = rows.column("id").to_numpy()
        self.length, self.gram, self.n_buckets = length, gram, n_buckets

    def parts(self):
        """Pieces of the block: first row, first byte, bytes, runs."""
        for i, j in pieces(self.offsets, RUN_BYTES):
            at = self.offsets[i]
            data = self.data[at:self.offsets[j]]
            yield i, at, data, runs(data, self.offsets[i:j + 1] - at, self.length, self.gram)

    def _grams(self, parts) -> tuple[np.ndarray, ...]:
        """Distinct grams: smallest id, whether there are several ids, and how many contexts."""
        key = np.concatenate([np.zeros(0, U), *(k for _, k, *_ in parts)])
        ids = np.concatenate([np.zeros(0, np.int64), *(self.ids[i:][text] for i, _, _, _, text in parts)])
        return *_distinct(key, ids), np.unique(key, return_counts=True)[1].astype(np.uint32)

    def grams(self) -> tuple[np.ndarray, ...]:
        return self._grams([(i, *r) for i, _, _, r in self.parts()])

    def contexts(self, answers: dict[int, bytes]):
        """Runs with a shared gram (start in the block, strings, text), and the distinct
        contexts: which one each run has; key, a place, size and smallest id of each."""
        kept = [(i, at, len(data), r) for i, at, data, r in self.parts()]
        key, *_ = self._grams([(i, *r) for i, _, _, r in kept])
        state = told(key, self.n_buckets, answers, np.uint8)
        key, hot = key[state > 0], state[state > 0] == _HOT
        found = []
        for i, begin, n, (gram, start, count, text) in kept:
            at = np.minimum(np.searchsorted(key, gram), max(0, len(key) - 1))
            which = np.flatnonzero(key[at] == gram) if len(key) else np.zeros(0, np.int64)
            if not len(which):
                continue
            data = self.data[begin:begin + n]
            one, other = _rolling(data, 9), _rolling(data, 10)
            apart = hot[at[which]]
            for some, alone in ((which[~apart], False), (which[apart], True)):
                first, many, row, own = start[some], count[some], text[some], gram[some]
                if alone:  # each string of a frequent gram is a context that goes by its own name
                    row, first = np.repeat(row, many), _expand(first, many)
                    many = np.ones(len(first), np.int64)
                end = first + many + self.length - 1
                x, y = one.of(first, end), other.of(first, end)
                found.append((mix64(x) if alone else own, x, y, first + begin, many, row + i))
        kinds = (U, U, U, np.int64, np.int64, np.int64)
        key, x, y, start, count, text = (np.concatenate([np.zeros(0, t), *(f[c] for f in found)]) for c, t in enumerate(kinds))
        order = np.lexsort((y, x, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        first = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(self.ids[text][order], first) if len(first) else np.zeros(0, np.int64)
        one = order[first]
        return start, count, text, which, key[one], start[one], count[one] + self.length - 1, low


def _gram_state(columns, hot: int) -> np.ndarray:
    """0: a gram of one id; 1: of several; ``_HOT``: of several, in over ``hot`` contexts."""
    key, low, several, n = columns
    order = np.argsort(key, kind="stable")
    first = groups(key[order])
    total = np.add.reduceat(n[order].astype(np.int64), first) > hot
    out = _is_shared((key, low, several), None).astype(np.uint8)
    out[order] += out[order] * np.repeat(total, np.diff(np.append(first, len(key)))).astype(np.uint8)
    return out


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id",
                     text_col: str = "text", hot: int = HOT_CONTEXTS) -> DataFrame:
    """(id, no_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    n = n_blocks(docs)
    n_buckets = max(4, 2 * n)
    blocks = in_blocks(docs, n, id_col, text_col)

    def ask_grams(block: int, rows: pa.Table) -> pa.Table:
        return ask_rows(block, n_buckets, *_Block(rows, length, gram, n_buckets).grams())

    def state(columns, owner):
        return _gram_state(columns, hot)

    grams = answer(for_blocks(blocks, ask_grams, ASK), [U, np.int64, bool, np.uint32], state)

    def ask_contexts(block: int, rows: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        b = _Block(rows, length, gram, n_buckets)
        *_, key, start, size, low = b.contexts(loads)
        cut = bucket_bounds(key, n_buckets)
        out = [(k, _load(key[i:j], size[i:j], low[i:j], b.data[_expand(start[i:j], size[i:j])].tobytes()))
               for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()),
                         "load": pa.array([x[1] for x in out], pa.binary())})

    def expand(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        key, low, asked = [], [], []
        for load in table.column("load"):
            k, size, ids, body = _unload(load.as_py())
            own, at = np.empty(len(k), np.int64), 0
            for e, (kk, m, i) in enumerate(zip(k.tolist(), size.tolist(), ids.tolist(), strict=True)):
                c = index.setdefault(body[at:at + m], len(key))
                if c == len(key):
                    key.append(kk)
                    low.append(i)
                elif i < low[c]:
                    low[c] = i
                own[e] = c
                at += m
            asked.append((own, ids))
        contexts, low = list(index), np.array(low, np.int64)
        by = np.argsort(np.array(key, U), kind="stable")
        strings = np.fromiter(map(len, contexts), np.int64, len(contexts)) - length + 1
        start = np.empty(len(contexts), np.int64)
        start[by] = np.cumsum(strings[by]) - strings[by]
        # strings only equal strings of their own gram: a gram's only context has nothing to meet
        key = np.array(key, U)
        alone = _only(key[by])
        flat = np.repeat(low[by], strings[by])
        met = by[~alone]
        if len(met):
            flat[np.repeat(~alone, strings[by])] = np.concatenate(
                [smallest_owner([contexts[c] for c in shard], low[shard], length) for shard in _shards(met, key, contexts)])
        back = [np.packbits(flat[_expand(start[own], strings[own])] < np.repeat(ids, strings[own])).tobytes() for own, ids in asked]
        return pa.table({"block": table.column("block").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int32()),
                         "load": pa.array(back, pa.binary())})

    contexts = with_answers(blocks, grams, ask_contexts, ASK).groupBy("bucket").applyInArrow(expand, ANSWER)
    both = grams.unionByName(contexts.select("block", (F.col("bucket") + n_buckets).alias("bucket"), "load"))

    def remove(block: int, rows: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        b = _Block(rows, length, gram, n_buckets)
        start, count, text, which, key, _, size, low = b.contexts({k: v for k, v in loads.items() if k < n_buckets})
        strings = size - length + 1
        cut = bucket_bounds(key, n_buckets)
        bits = [np.unpackbits(np.frombuffer(loads[k + n_buckets], np.uint8), count=int(strings[i:j].sum()))
                for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        at = np.cumsum(strings) - strings
        gone = bits[_expand(at[which], count)] | np.repeat(b.ids[text] > low[which], count)
        step = np.zeros(len(b.data) + 1, np.int32)
        begin = _expand(start, count)[gone]
        step[begin] += 1
        np.subtract.at(step, begin + length, 1)
        cover = np.cumsum(step[:-1]) > 0
        head = cover.copy()
        head[1:] &= ~cover[:-1]
        inner = b.offsets[:-1][b.offsets[:-1] < len(b.data)]
        head[inner] = cover[inner]
        lost = np.concatenate([[0], np.cumsum(cover)])[b.offsets]
        spans = np.concatenate([[0], np.cumsum(head)])[b.offsets]
        digest = []
        for i, j, k in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), np.diff(lost).tolist(), strict=True):
            kept = b.data[i:j][~cover[i:j]] if k else b.data[i:j]
            digest.append(hashlib.sha256(kept.tobytes()).hexdigest())
        return pa.table({"id": rows.column("id"), "no_id": rows.column("no_id"), "n_bytes": pa.array(np.diff(b.offsets), pa.int64()),
                         "n_removed": pa.array(np.diff(lost), pa.int64()), "n_spans": pa.array(np.diff(spans), pa.int64()),
                         "kept_sha256": pa.array(digest, pa.string())})

    return with_answers(blocks, both, remove, "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _only(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, those that occur once."""
    return (np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [True]]))


def _shards(by: np.ndarray, key: np.ndarray, contexts: list[bytes]):
    """Contexts in the order of their grams, cut between grams at about ``SHARD_BYTES``."""
    begin, held = 0, 0
    for i, c in enumerate(by.tolist()):
        if held > SHARD_BYTES and key[c] != key[by[i - 1]]:
            yield by[begin:i]
            begin, held = i, 0
        held += len(contexts[c]) + 1
    if begin < len(by):
        yield by[begin:]
