"""Table-level feature work (B9, D23, G8-G13): label and one-hot encoding,
imputation statistics, z-scores, interaction products.

Label codes come from a table of ranked distinct values joined to the rows,
so any number of categories works.  One-hot columns are named after values, so
their vocabulary is read by the driver: it is as long as the output is wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.operators.quantile import exact_quantiles
from casework.session import materialize


#: rows whose products are made at once
_VECTOR_ROWS = 512


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def vocabulary(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct non-null values of ``col`` as text."""
    vals = df.select(_q(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().collect()
    return sorted(r["v"] for r in vals)


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): the distinct values of ``col`` as text, ranked from 0.

    A range exchange gives every partition a stretch of the sorted values; the
    partitions' counts (one row each) give their first code."""
    vals = df.select(_q(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    ranged = materialize(vals.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("value")) - 1
    return ranged.withColumn("_i", within).join(F.broadcast(first), "_part").select(
        "value", (F.col("_first") + F.col("_i")).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code", vocab: dict | None = None,
                 fit: DataFrame | None = None) -> DataFrame:
    """Sorted classes -> 0..n-1 (text comparison); NULL and unseen -> NULL.

    Classes come from ``vocab[col]`` where given (a literal lookup, no join),
    else from the rows of ``fit`` (default: the rows encoded)."""
    out = df
    for c in cols:
        if vocab is not None and c in vocab:
            arr = F.array(*[F.lit(x) for x in vocab[c]]).cast("array<string>")
            pos = F.array_position(arr, _q(c).cast("string"))
            out = out.withColumn(c + suffix, F.when(pos > 0, (pos - 1).cast("int")))
        else:
            codes = label_codes(df if fit is None else fit, c)
            codes = codes.select(F.col("value").alias("_value"), F.col("code").alias(c + suffix))
            out = out.join(codes, _q(c).cast("string") == F.col("_value"), "left").drop("_value")
    return out


def label_decode(code, classes: list[str]) -> Column:
    """G8 inverse: code -> class text."""
    arr = F.array(*[F.lit(x) for x in classes])
    return F.element_at(arr, (F.col(code) if isinstance(code, str) else code).cast("int") + 1)


def one_hot(df: DataFrame, cols: list[str], vocab: dict | None = None,
            drop_source: bool = True) -> DataFrame:
    """One 0/1 column per category value, named ``<col>_<value>``.
    Missing and unseen values give all zeros (fit ``vocab`` on train data and
    pass it when encoding test data; an empty vocabulary gives no columns)."""
    known = {c: vocab[c] if vocab is not None and c in vocab else vocabulary(df, c) for c in cols}
    kept = [_q(c) for c in df.columns if not (drop_source and c in known)]
    return df.select(*kept, *[F.coalesce((_q(c).cast("string") == F.lit(x)).cast("int"), F.lit(0)).alias(f"{c}_{x}")
                              for c, values in known.items() for x in values])


def impute_stats(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """Fill values learned on the rows given: exact median for numeric
    columns, most frequent value (smallest on ties) for text columns.
    Output: (column_name, stat, fill_value) with the value as text."""
    parts = []
    if num_cols:
        long = df.select(*[_q(c).cast("double").alias(c) for c in num_cols]).unpivot(
            [], num_cols, "column_name", "value")
        med = exact_quantiles(long, "value", ["column_name"], (0.5,))
        parts.append(med.select("column_name", F.lit("median").alias("stat"),
                                F.col("quantile").cast("string").alias("fill_value")))
    if cat_cols:
        long = df.select(*[_q(c).cast("string").alias(c) for c in cat_cols]).unpivot(
            [], cat_cols, "column_name", "value").where(F.col("value").isNotNull())
        vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        best = vc.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("k"),
                                                            F.col("value").alias("v"))).alias("b"))
        parts.append(best.select("column_name", F.lit("most_frequent").alias("stat"),
                                 F.col("b.v").alias("fill_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute(df: DataFrame, num_cols: list[str], cat_cols: list[str],
           stats: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with learned statistics (learn on train, apply anywhere).
    The statistics (one value per column) are collected: bounded by the
    number of columns."""
    st = stats if stats is not None else impute_stats(df, num_cols, cat_cols)
    fills = {r["column_name"]: r["fill_value"] for r in st.collect()}
    cols = []
    for f in df.schema.fields:
        c = _q(f.name)
        if f.name in fills and fills[f.name] is not None:
            lit = F.lit(fills[f.name]).cast(f.dataType if f.name in num_cols or
                                            not isinstance(f.dataType, T.StringType)
                                            else "string")
            c = F.coalesce(c, lit)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def zscore(df: DataFrame, cols: list[str], fit: DataFrame | None = None, suffix: str = "_z",
           fill: float | None = 0.0) -> DataFrame:
    """(x - mean) / population std, statistics from ``fit`` (default: the
    same rows); zero variance -> scale 1.  NULLs are filled with ``fill`` first
    (missing features count as 0).  One aggregate; its one-row result
    is attached as scalar subqueries."""
    src = fit if fit is not None else df

    def filled(d):
        return d.fillna(fill, subset=cols) if fill is not None else d
    fs = filled(src)
    out = filled(df)
    # all statistics in one aggregate, attached as one (reused) scalar subquery
    st = fs.select(F.struct(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                            *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)])).scalar()
    for i, c in enumerate(cols):
        out = out.withColumn(f"_m_{c}", st[f"m{i}"]).withColumn(f"_s_{c}", st[f"s{i}"])
    for c in cols:
        s = F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        out = out.withColumn(c + suffix, (_q(c) - F.col(f"_m_{c}")) / s)
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def interaction_names(cols: list[str], degree: int = 3) -> list[tuple[str, tuple[str, ...]]]:
    """Names and members of every product of 1..degree distinct columns,
    in the usual (degree, then lexicographic position) order."""
    out = []
    for d in range(1, degree + 1):
        for combo in combinations(cols, d):
            out.append((" ".join(combo), combo))
    return out


def product(cols: tuple[str, ...]) -> Column:
    """One term of ``interaction_names``."""
    e = _q(cols[0]).cast("double")
    for c in cols[1:]:
        e = e * _q(c).cast("double")
    return e


def interactions(df: DataFrame, cols: list[str], degree: int = 3, keep: list[str] | None = None,
                 as_array: bool = False) -> DataFrame:
    """Products of 1..degree *distinct* columns (no powers), named by the
    joined column names, or with ``as_array`` one array column ``interactions``
    (in the order of ``interaction_names``).  The form never depends on the data."""
    keep = list(keep or [])
    terms = interaction_names(cols, degree)
    exprs = [product(combo).alias(name) for name, combo in terms]
    if as_array:
        return df.select(*[_q(k) for k in keep], F.array(*exprs).alias("interactions"))
    return df.select(*[_q(k) for k in keep], *exprs)


def interaction_vectors(df: DataFrame, cols: list[str], degree: int = 3, keep: list[str] | None = None,
                        out: str = "features") -> DataFrame:
    """The products of ``interactions`` as one vector column, made a batch of
    rows at a time whenever it is read: the columns ``cols`` (without NULL) are held, never their products."""
    keep = list(keep or [])
    at = {c: i for i, c in enumerate(cols)}
    combos = [combo for _, combo in interaction_names(cols, degree)]
    # the column after the last is 1: shorter products are padded with it
    factors = np.array([[at[c] for c in combo] + [len(cols)] * (degree - len(combo)) for combo in combos]).T
    values = df.select(*[_q(k) for k in keep], *[_q(c).cast("double").alias(c) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _VECTOR_ROWS):
                b = whole.slice(start, _VECTOR_ROWS)
                x = np.ones((len(cols) + 1, b.num_rows))
                for i in range(len(cols)):
                    x[i] = b.column(len(keep) + i).to_numpy(zero_copy_only=False)
                product = x[factors[0]]
                for f in factors[1:]:
                    product *= x[f]
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(combos)
                dense = [pa.array(np.ones(b.num_rows, np.int8)), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.list_(pa.int32())),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(product.T.ravel()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.StructArray.from_arrays(dense, ["type", "size", "indices", "values"])],
                                                 [*b.schema.names[:len(keep)], out])

    return values.mapInArrow(run, T.StructType([*values.schema.fields[:len(keep)], T.StructField(out, VectorUDT())]))
