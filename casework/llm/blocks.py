"""Whole texts as numpy arrays, and questions asked by key across blocks of documents.

Documents are dealt into blocks of a few MB by a hash of id and text.  A task
that holds a block turns its texts into arrays (``Words``).  To compare
blocks, each sends its distinct keys, packed and sorted, to the buckets that
own them (``ask``); a bucket sees the same key from all blocks and answers
each block in the order of its question (``answer``), so that keys never
travel back.  What a block sends is bounded by its own distinct keys, however
frequent a key is, and a bucket gets one packed row from a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: null ids come after every id
NO_ID = np.iinfo(np.int64).max
#: bytes of compressed input for a block
BLOCK_BYTES = 3 << 20
#: texts are turned into arrays in pieces of about so many bytes
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(seed: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers of a family."""
    base = np.arange(start, start + n, dtype=U) * U(0x9E3779B97F4A7C15) + U((seed * 0xD1342543DE82EF95 + 1) & (2**64 - 1))
    return mix64(base) | U(1)


def n_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for the input by its size on disk, as the planner knows it; where
    it does not (a size over 2^50), by the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, -(-size // block_bytes))


def in_blocks(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(block, id, no_id, text, more); null texts are empty, null ids are ``NO_ID``."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("block"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def byte_views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # an empty one stays chunked
        texts = pa.array([], pa.string())
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, as arrays.

    ``start`` and ``end`` are byte positions, ``first`` the index of each
    text's first word (one more entry than texts).
    """

    breaks = _SPACE

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        word = ~self.breaks[data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        starts[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = word[last]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._word, self._place = word, None

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def names(self, seed: int) -> np.ndarray:
        """A 64-bit name of each word: the sum of byte number x place number,
        scrambled with the length.  Another seed gives independent names."""
        if not len(self):
            return np.zeros(0, U)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        if self._place is None:
            letters = self.data[np.flatnonzero(self._word)]
            self._place = letters, (np.arange(len(letters), dtype=np.int32) - np.repeat(begin.astype(np.int32), length))
        letter, place = self._place
        terms = numbers(seed, 256)[letter] * numbers(seed + 1000, int(length.max()))[place]
        return mix64(np.add.reduceat(terms, begin) + length.astype(U) * U(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of stretches of a sequence of 64-bit names, from prefix sums."""

    _BASE = 0xD6E8FEB86659FD93
    _INV = pow(_BASE, -1, 2**64)

    def __init__(self, names: np.ndarray):
        n = len(names) + 1
        self.down = self._powers(self._INV, n)
        self.sums = np.zeros(n, U)
        np.cumsum(names * self._powers(self._BASE, n)[:-1], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, U(base), U)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def bucket_bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the 64-bit key space begins, and the end."""
    edges = (np.arange(1, n, dtype=object) * (2**64) // n).astype(U) if n > 1 else np.zeros(0, U)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(np.int64)


ASK = "bucket int, block int, load binary"
ANSWER = "block int, bucket int, load binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, end to end (the reader knows their types).  Each is
    laid out by byte place: first the lowest byte of all numbers, and so on, for
    the high bytes of ids and counts are mostly equal and then take no room."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)


def unpacked(load: bytes, *types, n: int | None = None, at: int = 0) -> list[np.ndarray]:
    """The arrays of ``packed``; ``n`` is their length if other bytes follow."""
    sizes = [np.dtype(t).itemsize for t in types]
    n = (len(load) - at) // sum(sizes) if n is None else n
    out = []
    for t, size in zip(types, sizes, strict=True):
        planes = np.frombuffer(load, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += n * size
    return out


def ask_rows(block: int, n_buckets: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """The question of a block: ``keys`` sorted, with columns, cut into buckets."""
    at = bucket_bounds(keys, n_buckets)
    rows = [(b, packed(keys[i:j], *[c[i:j] for c in columns]))
            for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                     "block": pa.array([block] * len(rows), pa.int32()),
                     "load": pa.array([r[1] for r in rows], pa.binary())})


def for_blocks(blocks: DataFrame, make: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``make(block, rows)`` for every block."""
    def run(table: pa.Table) -> pa.Table:
        return make(table.column("block")[0].as_py(), table)
    return blocks.groupBy("block").applyInArrow(run, schema)


def answer(asked: DataFrame, types: list, reply: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
    """Ask all buckets.  ``reply(columns, owner)`` gets the loads of a bucket end
    to end (column 0: the keys; ``owner``: the question each entry came from)
    and returns one value for each entry; these go back to their blocks."""
    def run(table: pa.Table) -> pa.Table:
        loads = [unpacked(x.as_py(), *types) for x in table.column("load")]
        sizes = [len(x[0]) for x in loads]
        columns = [np.concatenate([x[i] for x in loads]) for i in range(len(types))]
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        out = reply(columns, owner)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        back = [(np.packbits(out[i:j]) if out.dtype == bool else out[i:j]).tobytes()
                for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": table.column("block").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int32()),
                         "load": pa.array(back, pa.binary())})
    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def with_answers(blocks: DataFrame, answers: DataFrame, make: Callable[[int, pa.Table, dict[int, bytes]], pa.Table],
                 schema: str) -> DataFrame:
    """``make(block, rows, answers by bucket)`` for every block."""
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        loads = {b: x for b, x in zip(told.column("bucket").to_pylist(), told.column("load").to_pylist(), strict=True)}
        block = rows.column("block")[0].as_py() if rows.num_rows else told.column("block")[0].as_py()
        return make(block, rows, loads)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def told(keys: np.ndarray, n_buckets: int, loads: dict[int, bytes], kind) -> np.ndarray:
    """The answers to ``keys`` (sorted as asked), in their order."""
    at = bucket_bounds(keys, n_buckets)
    out = np.zeros(len(keys), kind)
    for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if j > i:
            raw = loads[b]
            out[i:j] = (np.unpackbits(np.frombuffer(raw, np.uint8), count=j - i).astype(bool)
                        if kind is bool else np.frombuffer(raw, kind))
    return out


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """The index of the first entry of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def arrow_table(schema: dict[str, pa.DataType], columns: dict) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in schema.items()})


def frame(rows: pa.Table) -> pd.DataFrame:
    return rows.to_pandas()
