"""Cleaning expressions (B5-B15).  All return JVM-side ``Column``s."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Outcome labels.
REJECT = "Avslag"
APPROVE = "Godkjent"
PERMIT = "Tillatelse"
ERROR = "Feil"
# Spellings that count as a rejection in the training data.
REJECT_SPELLINGS = ("Avslag", "Avslag etter klage")
# White space that hand-typed cells carry, the no-break spaces included.
BLANKS = r"[\s\u00A0\u2007\u202F]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """White space of any kind (line feeds, tabs, no-break spaces) cut at both ends."""
    return F.regexp_replace(_c(c), f"^{BLANKS}|{BLANKS}$", "")


def binary_outcome(decision, reject: str = REJECT, other: str = APPROVE) -> Column:
    """``reject`` when the decision equals it, else ``other`` (NULL too)."""
    return F.when(_c(decision).eqNullSafe(F.lit(reject)), F.lit(reject)).otherwise(F.lit(other))


def reject_flag(decision, spellings=REJECT_SPELLINGS) -> Column:
    """1 for any listed reject spelling, white space around it aside, else 0."""
    return F.when(strip(decision).isin(*[s.strip() for s in spellings]), F.lit(1)).otherwise(F.lit(0))


def has_label(c) -> Column:
    """The label is present (not NULL, not empty after trim)."""
    return _c(c).isNotNull() & (strip(c) != F.lit(""))


def parse_number(c) -> Column:
    """Locale number text -> double.

    Removes blanks and no-break spaces, turns the decimal comma into a dot and
    yields NULL for text that still does not parse (never NaN)."""
    s = F.regexp_replace(_c(c).cast("string"), BLANKS, "")
    s = F.translate(s, ",", ".")
    v = s.try_cast(T.DoubleType())
    return F.nanvl(v, F.lit(None).cast("double"))   # the text is read once


def squash_space(c) -> Column:
    """Trim and collapse runs of white space to one blank."""
    return F.regexp_replace(strip(c), BLANKS, " ")


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip every string cell."""
    return df.select(*[strip(F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: floating NaN becomes SQL NULL (Spark orders NaN above all)."""
    return df.select(*[F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """Constant fill with 0."""
    return df.fillna(0, subset=list(cols))


def complete_cases(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with any NULL in ``cols`` (all columns by default)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def drop_sparse_columns(df: DataFrame, min_non_null: int = 10, by: str | None = None) -> DataFrame:
    """Keep columns with at least ``min_non_null`` non-null values
    (in every group of ``by`` when given).  One aggregate pass, scalar result."""
    cols = [c for c in df.columns if c != by]
    aggs = [F.count(F.col(f"`{c}`")).alias(c) for c in cols]
    if by:
        row = df.groupBy(by).agg(*aggs).agg(*[F.min(c).alias(c) for c in cols]).first()
    else:
        row = df.agg(*aggs).first()
    keep = [c for c in cols if row is not None and (row[c] or 0) >= min_non_null]
    return df.select(*([by] if by else []), *[F.col(f"`{c}`") for c in keep])
