"""Contiguous shards of near equal bytes from global prefix sums (operator 8).

Documents are ordered by (doc_id, size, checksum of the text).  A range
exchange gives every partition one stretch of that order; the per-partition
totals (one small row for each partition) become the partitions' offsets, and
a window inside each partition finishes the prefix sums.  The byte axis is then
cut at equal targets: a row belongs to the shard in which its middle byte lies.

Only narrow rows (id, size, checksum) take part in the exchange.  Rows that are
equal in all three are counted first and travel once, so no number of repeated
rows meets in one task; their prefix sums follow by arithmetic.

Defined results: a null text has zero bytes and checksum 0; null ids come after
all others; repeated rows each get their own slot; an empty table gives an
empty result; more shards than rows leaves some shards without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.session import materialize

ROW_BYTES = 8
_KEY = ["_null_id", "_id", "_size", "_crc"]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> list:
    text = F.col(text_col).cast("binary")
    return [F.col(id_col).isNull().alias("_null_id"), F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("_size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc")]


def prefix_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct (id, size, checksum): ``n`` equal rows, and the
    bytes (``start``) and rows (``row``) that come before the first of them."""
    rows = docs.select(*_keyed(docs, id_col, text_col)).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    # The bounds of a range exchange come from a sample; both later reads must
    # see the same partitions, hence the checkpoint of the narrow rows.
    ranged = materialize(rows.repartitionByRange(*_KEY).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (ranged.groupBy("_part")
              .agg(F.sum(F.col("n") * F.col("_size")).alias("b"), F.sum("n").alias("c"))
              .select("_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"),
                      F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c0")))
    own = Window.partitionBy("_part").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged
            .withColumn("_b", F.coalesce(F.sum(F.col("n") * F.col("_size")).over(own), F.lit(0)))
            .withColumn("_c", F.coalesce(F.sum("n").over(own), F.lit(0)))
            # as many rows as partitions, two numbers each
            .join(F.broadcast(totals), "_part")
            .select(*_KEY, "n", (F.col("_b0") + F.col("_b")).alias("start"),
                    (F.col("_c0") + F.col("_c")).alias("row")))


def shard_positions(docs: DataFrame, n_shards: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``_id``, ``_size``, ``_crc``, ``copy`` (0.. among equal rows), ``shard``, ``slot``."""
    pos = materialize(prefix_positions(docs, id_col, text_col))
    total = pos.agg(F.coalesce(F.max(F.col("start") + F.col("n") * F.col("_size")), F.lit(1)).alias("t")).scalar()
    rows = (pos.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .withColumn("row", F.col("row") + F.col("copy"))
            .withColumn("start", F.col("start") + F.col("copy") * F.col("_size"))
            .withColumn("_total", total)
            .withColumn("shard", F.expr(f"cast(((2 * start + _size) * {int(n_shards)}) div (2 * _total) as int)")))
    # at most n_shards rows
    first = rows.groupBy("shard").agg(F.min("row").alias("_first"))
    return (rows.join(F.broadcast(first), "shard")
            .select(*_KEY, "n", "copy", "shard", (F.col("row") - F.col("_first")).alias("slot")))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; all its columns and rows stay.

    A column of ``docs`` already named ``shard`` or ``slot`` is replaced.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    pos = shard_positions(docs, n_shards, id_col, text_col)
    key = [k for k in _KEY if k != "_null_id"]
    # a document travels as one column, so its names cannot meet ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), *_keyed(docs, id_col, text_col)[1:])
    whole = lambda df: df.select(*[F.col("_doc").getField(c).alias(c) for c in keep], "shard", "slot")
    same = lambda a, b, cols: [a[k].eqNullSafe(b[k]) for k in cols]
    single = whole(rows.join(pos.where("n = 1"), same(rows, pos, key), "inner"))
    # only rows that occur more than once need to be told apart: they are numbered
    # within the partitions they lie in, after those of the partitions before
    again = pos.where("n > 1")
    which = materialize(rows.join(again.select(*key).distinct(), same(rows, again, key), "left_semi")
                        .withColumn("_part", F.spark_partition_id()))
    first = (which.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_before", F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n")).drop("_n"))
    own = which.withColumn("_i", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.lit(0))) - 1)
    numbered = own.join(first, same(own, first, [*key, "_part"]), "inner").select(
        "_doc", *[own[k] for k in key], (F.col("_before") + F.col("_i")).cast("long").alias("copy"))
    return single.unionByName(whole(numbered.join(again, same(numbered, again, [*key, "copy"]), "inner")))
