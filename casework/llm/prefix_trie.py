"""Conversation prefix trie from adaptive radix trees (operator 12).

A turn's id is a fixed-width big-endian number of 16 bytes, the md5 of its role
(with its length before it) and text, so a conversation is a key of 16 bytes a
turn, and texts are read once and never moved.  Equal keys are counted first.
The distinct keys are range-partitioned; every partition builds an adaptive
radix tree of its stretch: nodes of 4, 16, 48 or 256 children that grow as they
fill, and compressed paths.  A path may cross several turns or end inside one:
only byte depths that are whole turns are nodes of the trie and give rows.

A trie node is spread over partitions only if it is a prefix of the first or
the last key of each, so each partition reports these two paths as parts, with
the sums of what hangs off them; the parts are added by name (a chained hash),
and one small pass over the merged paths finishes their sums.  Everything else
is final where it was built.  Copies, a first turn that all conversations share
or a deep common prefix therefore cost no partition more than its stretch.

Order within a conversation comes from a range exchange by (conversation, turn,
id), whose stretches are packed: a long conversation is spread over tasks until
its ids (20 bytes a turn) form its key, which one task holds.  The members that
end at a node are listed in ascending order by a range exchange too, in pieces,
and pass the digest as a stream, piece by piece.

Defined results: rows without conversation id take no part; null turns come
first, null roles and texts are empty, turns of one number are ordered by their
ids (so repeated rows are consecutive equal turns); an empty table gives no
nodes, any other a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.session import materialize

WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
#: turns of one conversation packed together, and bytes of members listed together
RUN_TURNS = 4096
PIECE_BYTES = 1 << 16
#: keys and bytes of keys that one radix tree holds
TREE_KEYS = 50_000
TREE_BYTES = 8 << 20
#: merged path nodes are broadcast up to so many
BROADCAST_ROWS = 100_000


class Few:
    """Up to ``room`` children, their bytes in order (nodes of 4 and 16)."""

    __slots__ = ("room", "keys", "kids")

    def __init__(self, room: int = 4, keys: bytes = b"", kids: list | None = None):
        self.room, self.keys, self.kids = room, bytearray(keys), kids or []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid) -> Few | Indexed:
        at = self.keys.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return self
        if len(self.keys) == self.room:
            return (Few(16, self.keys, self.kids) if self.room == 4 else Indexed(self.items())).put(byte, kid)
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> list[tuple]:
        return list(zip(self.keys, self.kids, strict=True))


class Indexed:
    """Up to 48 children behind an index of 256 places."""

    __slots__ = ("place", "kids")

    def __init__(self, items: list[tuple]):
        self.place, self.kids = bytearray(256), []
        for byte, kid in items:
            self.kids.append(kid)
            self.place[byte] = len(self.kids)

    def get(self, byte: int):
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid) -> Indexed | Full:
        if self.place[byte]:
            self.kids[self.place[byte] - 1] = kid
            return self
        if len(self.kids) == 48:
            return Full(self.items()).put(byte, kid)
        self.kids.append(kid)
        self.place[byte] = len(self.kids)
        return self

    def items(self) -> list[tuple]:
        return [(b, self.kids[at - 1]) for b, at in enumerate(self.place) if at]


class Full:
    """A place for every byte."""

    __slots__ = ("kids",)

    def __init__(self, items: list[tuple]):
        self.kids = [None] * 256
        for byte, kid in items:
            self.kids[byte] = kid

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> Full:
        self.kids[byte] = kid
        return self

    def items(self) -> list[tuple]:
        return [(b, kid) for b, kid in enumerate(self.kids) if kid is not None]


class Node:
    """``path``: the bytes below the byte that leads here; ``row``: of the key that ends here, or -1."""

    __slots__ = ("path", "kids", "row")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.row, self.kids = path, row, Few()


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - 1 - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() - 1) // 8


class RadixTree:
    """An adaptive radix tree of distinct byte strings."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, row: int) -> None:
        if self.root is None:
            self.root = Node(key, row)
            return
        node, at, above = self.root, 0, None
        while True:
            same = common(node.path, key[at:at + len(node.path)])
            if same < len(node.path):  # the path is cut in two
                top = Node(node.path[:same])
                byte, node.path = node.path[same], node.path[same + 1:]
                top.kids = top.kids.put(byte, node)
                if above is None:
                    self.root = top
                else:
                    above[0].kids = above[0].kids.put(above[1], top)
                node = top
            at += same
            if at == len(key):
                node.row = row
                return
            below = node.kids.get(key[at])
            if below is None:
                node.kids = node.kids.put(key[at], Node(key[at + 1:], row))
                return
            above, node, at = (node, key[at]), below, at + 1


_NODE = {"edge": pa.bool_(), "name": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "conv": pa.int64(),
         "parent_conv": pa.int64(), "n": pa.int64(), "kids": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(),
         "ends": pa.string(), "chars": pa.int64()}
NODE = ("edge boolean, name binary, parent binary, depth long, conv long, parent_conv long, n long, kids long, leaves long, "
        "saved long, ends string, chars long")


def path_names(key: bytes) -> list[bytes]:
    """A name for each whole-turn prefix: the hash of the last one's name and the turn's id."""
    names = [b""]
    for at in range(0, len(key), WIDTH):
        names.append(hashlib.md5(names[-1] + key[at:at + WIDTH]).digest())
    return names


def trie_nodes(keys: list[bytes], chars: list[np.ndarray], counts: list[int], lows: list[int], ends: list[str]) -> dict[str, list]:
    """Columns of ``_NODE`` for a sorted stretch of distinct keys; the nodes on the
    first and the last key are parts (``edge``) that hold only what hangs off them."""
    tree = RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)
    paths = [(keys[0], path_names(keys[0])), (keys[-1], path_names(keys[-1]))]

    # parents before children
    order, above, begin, end = [tree.root], [-1], [0], [len(tree.root.path)]
    at = 0
    while at < len(order):
        for _, kid in order[at].kids.items():
            order.append(kid)
            above.append(at)
            begin.append(end[at])
            end.append(end[at] + 1 + len(kid.path))
        at += 1
    size = len(order)
    n, low, rep = [0] * size, [0] * size, [0] * size
    leaves, saved, tops = [0] * size, [0] * size, [0] * size
    for x in range(size - 1, -1, -1):   # children before parents
        row = order[x].row
        if row >= 0:
            low[x] = lows[row] if not n[x] else min(low[x], lows[row])
            n[x] += counts[row]
            rep[x] = row
        leaves[x] = leaves[x] or 1
        first, last = begin[x] // WIDTH, end[x] // WIDTH
        saved[x] += (n[x] - 1) * int(chars[rep[x]][first:last].sum())
        up = above[x]
        if up >= 0:
            low[up] = low[x] if not n[up] else min(low[up], low[x])
            n[up] += n[x]
            rep[up] = rep[x]
            leaves[up] += leaves[x]
            saved[up] += saved[x]
            tops[up] += 1 if last > first else tops[x]

    out = {k: [] for k in _NODE}

    def emit(**row) -> int:
        for k, v in row.items():
            out[k].append(v)
        return len(out["n"]) - 1

    holder = [None] * size   # the place of the lowest whole-turn node at or above each radix node
    for x in range(size):
        at = holder[above[x]] if x else None
        key, row = keys[rep[x]], order[x].row
        own_chars, rest = chars[rep[x]], saved[x]
        edge = max(min(common(key, path) // WIDTH, end[x] // WIDTH) for path, _ in paths)
        for depth in range(begin[x] // WIDTH + 1 if x else 0, end[x] // WIDTH + 1):
            prefix = depth * WIDTH
            here = int(own_chars[depth - 1]) if depth else 0
            is_end = row >= 0 and prefix == end[x]
            kids = tops[x] if depth == end[x] // WIDTH else 1
            held = dict(depth=depth, conv=low[x], n=n[x], ends=ends[row] if is_end else EMPTY, chars=here)
            if depth <= edge:
                names = next(names for path, names in paths if path[:prefix] == key[:prefix])
                at = emit(edge=True, name=names[depth], parent=names[depth - 1] if depth else None, parent_conv=None,
                          kids=0, leaves=0, saved=0, **held)
            else:
                if out["edge"][at]:  # hangs off a part
                    out["kids"][at] += 1
                    out["leaves"][at] += leaves[x]
                    out["saved"][at] += rest
                    up = dict(parent=out["name"][at], parent_conv=None)
                else:
                    up = dict(parent=None, parent_conv=out["conv"][at])
                at = emit(edge=False, name=None, kids=kids, leaves=leaves[x], saved=rest, **up, **held)
            rest -= (n[x] - 1) * here
        holder[x] = at
    return out


def finish_paths(rows: list[dict]) -> list[dict]:
    """The merged nodes of the partitions' first and last keys, with whole sums."""
    by_name = {r["name"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        r["leaves"] = r["leaves"] if r["kids"] else 1
        r["saved"] += (r["n"] - 1) * r["chars"]
        if r["depth"]:
            up = by_name[r["parent"]]
            up["kids"] += 1
            up["leaves"] += r["leaves"]
            up["saved"] += r["saved"]
            r["parent_conv"] = up["conv"]
    return rows


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, id, chars): the id and the code points of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.length(text).alias("chars"))


def packed_runs(turns: DataFrame) -> DataFrame:
    """(conv, runs): each conversation's turns in order, as packed runs (part, at, ids, chars)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            conv, chars = b.column("conv").to_numpy(), b.column("chars").to_numpy().astype(np.int32)
            ids = b.column("id").to_pylist()
            cuts = np.flatnonzero(conv[1:] != conv[:-1]) + 1
            out = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)], strict=True):
                for k in range(i, j, RUN_TURNS):
                    m = min(j, k + RUN_TURNS)
                    out.append((int(conv[i]), part, at, b"".join(ids[k:m]), chars[k:m].tobytes()))
                    at += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                                             ["conv", "part", "at", "ids", "chars"])

    key = ["conv", F.col("turn").asc_nulls_first(), "id"]
    runs = (turns.repartitionByRange(*key).sortWithinPartitions(*key)
            .mapInArrow(run, "conv long, part int, at long, ids binary, chars binary"))
    return runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "at", "ids", "chars"))).alias("runs"))


def regrafted(runs: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(conv, name, key, chars): conversations whose first ``crc32(conv) % heads`` turns
    are those of the family's first one, ``conv - conv % family``."""
    # a run has a turn at least
    joined = lambda c: F.aggregate(F.slice(f"runs.{c}", 1, heads), F.lit(b""), lambda a, x: F.concat(a, x))
    first = (runs.where(F.col("conv") % family == 0)
             .select(F.col("conv").alias("base"), *[F.substring(joined(c), 1, (heads - 1) * w).alias(f"head_{c}") for c, w in (("ids", WIDTH), ("chars", 4))]))
    rows = (runs.withColumn("base", F.col("conv") - F.col("conv") % family).join(first, "base", "left")
            .select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h"),
                    "runs.ids", "runs.chars", "head_ids", "head_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys, sizes = [], [], []
            for h, ids, chars, head, head_chars in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                key = (head or b"")[:h * WIDTH] + b"".join(ids)[h * WIDTH:]
                keys.append(key)
                sizes.append((head_chars or b"")[:h * 4] + b"".join(chars)[h * 4:])
                names.append(hashlib.md5(key).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(keys, pa.binary()),
                                              pa.array(sizes, pa.binary())], ["conv", "name", "key", "chars"])

    return rows.mapInArrow(run, "conv long, name binary, key binary, chars binary")


def member_digests(members: DataFrame) -> DataFrame:
    """(name, n, low, ends): the members (``conv``) of each name, counted, the smallest,
    and the sha256 of all in ascending order, joined by commas."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        kinds = {"name": pa.binary(), "part": pa.int32(), "at": pa.int64(), "n": pa.int64(), "low": pa.int64(), "list": pa.binary()}
        for b in batches:
            names, convs, out = b.column("name").to_pylist(), b.column("conv").to_pylist(), {k: [] for k in kinds}
            i = 0
            while i < len(names):
                j, bytes_ = i, 0
                while j < len(names) and names[j] == names[i] and bytes_ < PIECE_BYTES:
                    bytes_ += 20
                    j += 1
                for k, v in zip(kinds, (names[i], part, at, j - i, convs[i], ",".join(map(str, convs[i:j])).encode()), strict=True):
                    out[k].append(v)
                i, at = j, at + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = state = None
        kinds = {"name": pa.binary(), "n": pa.int64(), "low": pa.int64(), "ends": pa.string()}
        out: dict[str, list] = {k: [] for k in kinds}

        def close() -> None:
            if state is not None:
                for k, v in zip(kinds, (name, n, low, state.hexdigest()), strict=True):
                    out[k].append(v)

        for b in batches:
            for own, count, least, part in zip(*(b.column(c).to_pylist() for c in ("name", "n", "low", "list")), strict=True):
                if own != name:
                    close()
                    name, n, low, state = own, 0, least, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part)
                n += count
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))
            out = {k: [] for k in kinds}
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    pieces = (members.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
              .mapInArrow(listed, "name binary, part int, at long, n long, low long, list binary"))
    return (pieces.repartition("name").sortWithinPartitions("name", "part", "at")
            .mapInArrow(digested, "name binary, n long, low long, ends string"))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                tree_keys: int = TREE_KEYS, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row for each distinct sequence of first turns: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    members = materialize(regrafted(packed_runs(turns_of(df, conv_col, turn_col, role_col, text_col))))
    keys = members.groupBy("name").agg(F.any_value(F.struct("key", "chars")).alias("k")).select("name", "k.key", "k.chars")
    keys = materialize(keys.join(member_digests(members), "name"))
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("b")).first()
    n_trees = max(1, -(-size["n"] // tree_keys), -(-size["b"] // tree_bytes))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None  # about tree_keys keys of tree_bytes
        if table is not None and table.num_rows:
            out = trie_nodes(table.column("key").to_pylist(), [np.frombuffer(c, np.int32).astype(np.int64) for c in table.column("chars").to_pylist()],
                             *(table.column(c).to_pylist() for c in ("n", "low", "ends")))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _NODE.items()], list(_NODE))

    def whole(table: pa.Table) -> pa.Table:
        rows = finish_paths(table.to_pylist())
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in _NODE.items()})

    nodes = materialize(keys.repartitionByRange(n_trees, "key").sortWithinPartitions("key").mapInArrow(grown, NODE))
    parts = nodes.where("edge").groupBy("name").agg(
        F.first("edge").alias("edge"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"),
        F.max("parent_conv").alias("parent_conv"), F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.coalesce(F.max(F.when(F.col("ends") != EMPTY, F.col("ends"))), F.lit(EMPTY)).alias("ends"),
        F.max("chars").alias("chars"))
    # two keys a tree: as many turns as these have, however many conversations there are
    paths = materialize(parts.select(*_NODE).groupBy("edge").applyInArrow(whole, NODE))
    plain = nodes.where("not edge")
    up = paths.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    hung = plain.where("parent is not null").drop("parent_conv").join(
        F.broadcast(up) if up.count() <= BROADCAST_ROWS else up, "parent").select(*_NODE)
    return plain.where("parent is null").unionByName(hung).unionByName(paths).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"))
