"""Browsing: faceted filters, row ids, single-case lookup.

Filters are plain Column predicates so Catalyst pushes the equality/range
parts into the Parquet scan (``PushedFilters``); dates are derived once so
the since-filter is a plain comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def facet_predicate(facets: dict[str, list] | None = None,
                    ranges: dict[str, tuple] | None = None,
                    since: tuple[str, str] | None = None) -> Column:
    """AND of non-empty ``isin`` facets, inclusive ranges (a missing
    value fails a range) and ``date >= since`` (bad dates are NULL and fail).

    Meant for ``where``: a NULL comparison drops the row like False, and the
    plain comparisons are pushed into the Parquet scan."""
    parts = []
    for c, vals in (facets or {}).items():
        if vals:
            parts.append(_q(c).isin(*vals))
    for c, (lo, hi) in (ranges or {}).items():
        parts.append((_q(c) >= F.lit(lo)) & (_q(c) <= F.lit(hi)))
    if since:
        col, d = since
        parts.append(_q(col) >= F.to_date(F.lit(d)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _key_text(values: list[Column]) -> Column:
    """Key cells as one text that no other key has: each with its length, NULL as a dash."""
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def row_id_expr(cols: list[str]) -> Column:
    """Deterministic surrogate id = sha256 of the key columns (stable
    across retries and partitionings, unlike random UUIDs)."""
    return F.sha2(_key_text([_q(c).cast("string") for c in cols]), 256)


def with_row_id(df: DataFrame, cols: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """The id of each row: of its key ``cols``, or, without a key, of all its
    columns and an occurrence number, so that equal rows get ids of their own.
    Equal rows are counted, not gathered, and numbered when spread out again."""
    if cols is not None:
        return df.withColumn(name, row_id_expr(cols))
    counted = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    key = _key_text([*[_q(c).cast("string") for c in df.columns], F.col("_i").cast("string")])
    return each.select(*[_q(c) for c in df.columns], F.sha2(key, 256).alias(name))


def row_id_of(values: list) -> Column:
    """The id a row with these key values (texts or columns) gets."""
    return F.sha2(_key_text([v if isinstance(v, Column) else F.lit(v).cast("string") for v in values]), 256)


def by_id(df: DataFrame, id_col: str, value) -> DataFrame:
    """The case(s) with the given id."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.where(_q(id_col) == v)
