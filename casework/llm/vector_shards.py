"""Shards of vectors that lie close together, and queries sent to the shards that matter.

``whole_rows`` turns vectors into whole numbers and gives every row a number of
its own.  ``dealt`` puts the rows into shards by a range exchange on length,
label and place (the interleaved bits of the means of a few stretches), so that
a shard is a small region and its bounds say something.  A shard is one task's
partition of about ``shard_rows`` rows, whatever the input.

Searching never copies the rows.  ``at_home`` runs over the partitions as they
lie.  ``routed`` meets queries with the shards' summaries, one small row each,
and keeps the (query, shard) pairs that a bound lets pass; ``streamed`` sends
those queries to their shards: rows and queries are sorted by shard, a task
holds one shard and lets its queries go by in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from casework.session import materialize

SHARD_ROWS = 16_384
#: summaries and queries that meet in one group when queries are routed
ROUTE_SHARDS = 2048
ROUTE_QUERIES = 8192
#: queries that pass a shard together
BATCH = 256
_PLACES = 4
_ITEM = {"row": pa.int64(), "id": pa.int64(), "label": pa.int64(), "dim": pa.int32(), "vec": pa.binary()}
ITEM = "row long, id long, label long, dim int, vec binary"


def arrow(schema: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], list(schema))


def matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.int64).reshape(len(vecs), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles while they fit 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise OverflowError("an inner product does not fit 64 bits")


def _place(x: np.ndarray) -> np.ndarray:
    """Interleaved bits of the ranks in size of a few stretches' means: near rows, near numbers."""
    out = np.zeros(len(x), np.int64)
    length = np.sqrt((x * x).sum(axis=1)) + 1e-300
    for i, part in enumerate(np.array_split(np.arange(x.shape[1]), _PLACES)):
        if len(part):
            share = x[:, part].sum(axis=1) / (np.sqrt(len(part)) * length)
            step = np.clip((share + 1) * 2**11, 0, 2**12 - 1).astype(np.int64)
            for bit in range(12):
                out |= ((step >> bit) & 1) << (bit * _PLACES + i)
    return out


def whole_rows(df: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding",
               label_col: str | None = None) -> DataFrame:
    """(row, id, label, dim, vec, place): floor(scale x) of every usable vector as packed 64-bit numbers."""
    schema = {**{k: t for k, t in _ITEM.items() if k != "row"}, "place": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in schema}
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if i is None or label is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64)
                if not len(x) or not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if np.abs(x).max() >= 2**62:
                    raise OverflowError(f"vector {i} does not fit whole numbers")
                out["id"].append(i)
                out["label"].append(label)
                out["dim"].append(len(x))
                out["vec"].append(x.astype(np.int64).tobytes())
                out["place"].append(int(_place(x[None])[0]))
            yield arrow(schema, out)

    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    rows = (df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
            .mapInArrow(run, "id long, label long, dim int, vec binary, place long"))
    # the checkpoint fixes the numbers of the rows
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def dealt(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with their ``shard``, one partition a shard and length."""
    n = max(1, -(-rows.count() // shard_rows))
    ranged = rows.repartitionByRange(n, "dim", "label", "place", "row").withColumn("shard", F.spark_partition_id())
    return materialize(ranged.select("shard", "row", "id", "label", "dim", "vec"))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition, each length apart."""
    whole = pa.Table.from_batches(list(batches)) if batches else None
    if whole is not None and whole.num_rows:
        dims = whole.column("dim").to_numpy()
        for d in np.unique(dims):
            yield whole.filter(pa.array(dims == d))


def at_home(shards: DataFrame, make: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``make(rows)`` of every shard where it lies, without an exchange."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # one shard, or a part of one: about shard_rows rows
        for table in _by_shard(batches):
            yield from make(table)
    return shards.mapInArrow(run, schema)


def summaries(shards: DataFrame, make: Callable[[np.ndarray], np.ndarray],
              merge: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(shard, dim, low, high, load): labels' range and ``make(vectors)``, one row a shard.
    ``merge`` joins the loads of a shard's parts, one a row."""
    def part(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = table.column("shard").to_numpy()
        x, label = matrix(table.column("vec").to_pylist()), table.column("label").to_numpy()
        for s in np.unique(shard):
            own = shard == s
            yield arrow(_SUMMARY, {"shard": [int(s)], "dim": [x.shape[1]], "low": [label[own].min()], "high": [label[own].max()],
                                   "load": [make(x[own]).astype(np.float64).tobytes()]})

    def whole(table: pa.Table) -> pa.Table:
        loads = np.stack([np.frombuffer(v, np.float64) for v in table.column("load").to_pylist()])
        return pa.Table.from_batches([arrow(_SUMMARY, {
            "shard": table.column("shard").to_pylist()[:1], "dim": table.column("dim").to_pylist()[:1],
            "low": [min(table.column("low").to_pylist())], "high": [max(table.column("high").to_pylist())],
            "load": [merge(loads).tobytes()]})])

    schema = "shard int, dim int, low long, high long, load binary"
    return at_home(shards, part, schema).groupBy("shard", "dim").applyInArrow(whole, schema)


_SUMMARY = {"shard": pa.int32(), "dim": pa.int32(), "low": pa.int64(), "high": pa.int64(), "load": pa.binary()}


def routed(queries: DataFrame, shards: DataFrame, may: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], np.ndarray]) -> DataFrame:
    """``queries`` once for each shard they must see, as column ``to``.

    ``may(queries, vectors, shards, loads)`` says which pairs pass.  Queries and
    summaries meet in groups of bounded size."""
    n_queries, n_shards = (max(1, -(-df.count() // size)) for df, size in ((queries, ROUTE_QUERIES), (shards, ROUTE_SHARDS)))
    pick = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("_q", pick("row", n_queries)).withColumn("_s", every(n_shards))
    held = shards.withColumn("_s", pick("shard", n_shards)).withColumn("_q", every(n_queries))
    fields = queries.schema.fields
    names = [f.name for f in fields]

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        if q.num_rows and s.num_rows:
            loads = np.stack([np.frombuffer(v, np.float64) for v in s.column("load").to_pylist()])
            at, to = np.nonzero(may(q, matrix(q.column("vec").to_pylist()), s, loads))
        else:
            at = to = np.zeros(0, np.int64)
        out = q.select(names).take(pa.array(at))
        goal = s.column("shard").to_numpy()[to] if s.num_rows else to
        return out.append_column("to", pa.array(goal, pa.int32()))

    schema = StructType([*fields, StructField("to", IntegerType())])
    key = ["dim", "_q", "_s"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, schema)


def streamed(shards: DataFrame, queries: DataFrame, prepare: Callable[[pa.Table], object],
             search: Callable[[object, pa.Table], pa.RecordBatch], schema: str, batch: int = BATCH) -> DataFrame:
    """``search(prepare(rows of a shard), queries)`` for queries ``to`` that shard, by batches.

    ``queries`` have the columns of the rows (``ITEM``) and more."""
    more = [c for c in queries.columns if c not in (*_ITEM, "to")]
    kinds = {f.name: f.dataType for f in queries.schema.fields}
    asked = queries.withColumn("shard", F.col("to")).withColumn("_asks", F.lit(1)).select("shard", "dim", "_asks", "row", "id", "label", "vec", *more)
    held = shards.withColumn("_asks", F.lit(0)).select(
        "shard", "dim", "_asks", "row", "id", "label", "vec", *[F.lit(None).cast(kinds[c]).alias(c) for c in more])
    n = max(1, shards.select("shard").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ready = None, [], None
        for b in batches:
            table = pa.Table.from_batches([b])
            shard, dim, asks = (table.column(c).to_numpy() for c in ("shard", "dim", "_asks"))
            turn = np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *turn], [*turn, len(shard)], strict=True):
                if j == i:
                    continue
                key = (shard[i], dim[i])
                if key != at:
                    at, rows, ready = key, [], None
                if not asks[i]:
                    rows.append(table.slice(i, j - i))
                    continue
                if ready is None and rows:
                    ready, rows = prepare(pa.concat_tables(rows)), []
                for k in range(i, j, batch) if ready is not None else ():
                    yield search(ready, table.slice(k, min(batch, j - k)))

    return (held.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "dim", "_asks")
            .mapInArrow(run, schema))
