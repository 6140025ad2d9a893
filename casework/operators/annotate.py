"""Annotation merge and reconciliation.

The annotation table is reduced to one row per key *before* the join (a
hash aggregate with map-side partial aggregation), so the join fans out only
to matching base rows and never multiplies annotation rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def common_keys(base: DataFrame, ann: DataFrame, candidates: list[str]) -> list[str]:
    """the candidate key columns present in both schemas (schema check only)."""
    b, a = set(base.columns), set(ann.columns)
    keys = [k for k in candidates if k in b and k in a]
    if not keys:
        raise ValueError("no common key columns")
    return keys


def last_non_null(ann: DataFrame, keys: list[str], value: str, order: str,
                  out: str | None = None) -> DataFrame:
    """Per key, the value of the latest row (by ``order``) whose value is not
    NULL; NULL when the key has only NULL values.  Rows with a NULL key part
    are dropped (they never match)."""
    out = out or value
    kept = ann.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    return kept.groupBy(*[_q(k) for k in keys]).agg(
        F.max_by(_q(value), F.when(_q(value).isNotNull(), _q(order))).alias(out))


def merge_annotations(base: DataFrame, ann: DataFrame, candidates: list[str], value: str,
                      order: str, out: str | None = None) -> DataFrame:
    """Left join of the per-key annotation onto every matching base row."""
    keys = common_keys(base, ann, candidates)
    per_key = last_non_null(ann.select(*keys, value, order), keys, value, order, out)
    return base.join(per_key, keys, "left")


def unmatched_keys(base: DataFrame, ann: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct annotation keys that no base row has."""
    ak = ann.select(*keys).dropna().distinct()
    return ak.join(base.select(*keys).dropna().distinct(), keys, "left_anti")


def duplicate_keys(base: DataFrame, ann: DataFrame, keys: list[str]) -> DataFrame:
    """Keys seen more than once in the base, with the number of
    annotation rows that carry them (a semi-join in count form)."""
    dup = (base.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_base"))
           .where(F.col("n_base") > 1))
    na = ann.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ann"))
    return (dup.join(na, keys, "left")
            .select(*keys, F.col("n_base").cast("long").alias("n_base"),
                    F.coalesce("n_ann", F.lit(0)).cast("long").alias("n_ann")))


def duplicate_annotations(base: DataFrame, ann: DataFrame, keys: list[str], value: str,
                          order: str) -> DataFrame:
    """The per-key annotation rows (last value) of the keys that the base repeats."""
    dup = duplicate_keys(base, ann, keys).select(*keys)
    return last_non_null(ann.select(*keys, value, order), keys, value, order).join(dup, keys, "left_semi")


def reconcile(base: DataFrame, ann: DataFrame, merged: DataFrame, keys: list[str],
              value: str, merged_col: str) -> DataFrame:
    """D3: annotation rows with a value, base rows that received one, and their
    difference (negative where repeated base keys receive one value several times)."""
    total = ann.select(F.count(_q(value))).scalar()
    m = merged.agg(F.count(_q(merged_col)).alias("transferred"))
    return (m.withColumn("annotated", total)
            .select(F.col("annotated").cast("long"), F.col("transferred").cast("long"),
                    (F.col("annotated") - F.col("transferred")).cast("long").alias("missing")))
