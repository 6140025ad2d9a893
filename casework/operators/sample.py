"""Sampling and splitting.

Everything is deterministic and repeatable in SQL: rows are ordered by an
integer arithmetic hash of their key, a number or a text (no ``rand()``, no
``monotonically_increasing_id``), so retries and different partitionings give
the same rows.

Exact per-stratum quotas ("the m first rows of each stratum by (hash, key)")
are chosen without a window over a whole stratum (a class can hold a third of
all rows): counts per (stratum, range of hash values) locate the range with the
boundary, counts per hash value in it the boundary value, and only the rows of
that one value (about n / 1e6 of the stratum) are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.session import few_rows

# Fixed parameters of the arithmetic hash (prime modulus, Knuth multiplier).
HASH_MOD = 1000003
HASH_MUL = 2654435761
# Bag index stride in the per-bag key (key * stride + bag); bags < stride.
BAG_STRIDE = 1009


#: ranges of hash values that are counted first
_RANGES = 4096


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def hash_params(seed: int) -> tuple[int, int]:
    """Multiplier and offset of the affine hash for ``seed``.  Different seeds
    give different permutations of the residues (not just a rotation)."""
    a = (HASH_MUL + seed * 7919) % HASH_MOD or 1
    b = (seed * 104729) % HASH_MOD
    return a, b


def key_number(key) -> Column:
    """A whole number for a key: itself if it is one, else the first 52 bits of
    its text's md5 (DuckDB has both).  NULL stays NULL."""
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(k.try_cast("long"), F.conv(F.substring(F.md5(k.cast("string")), 1, 13), 16, 10).cast("long"))


def hash_bucket(key, seed: int = 0) -> Column:
    """Integer hash in [0, HASH_MOD): ((key mod P) * a_seed + b_seed) mod P.
    Overflow-free for any key, a number or a text such as the ids of
    ``browse.with_row_id``; DuckDB computes the same value."""
    a, b = hash_params(seed)
    return F.pmod(F.pmod(key_number(key), F.lit(HASH_MOD)) * F.lit(a) + F.lit(b), F.lit(HASH_MOD))


def hash_split(df: DataFrame, key: str, fractions=(0.6, 0.4), names=("train", "test"),
               seed: int = 42, out: str = "split") -> DataFrame:
    """G1: reproducible random split by the hash fraction u = h / P."""
    u = hash_bucket(key, seed) / F.lit(float(HASH_MOD))
    expr, acc = None, 0.0
    for frac, name in zip(fractions[:-1], names[:-1]):
        acc += frac
        expr = (F.when(u < F.lit(acc), F.lit(name)) if expr is None
                else expr.when(u < F.lit(acc), F.lit(name)))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return df.withColumn(out, expr)


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Equal in all ``cols``; NULL equals NULL, so that no row is lost."""
    return reduce(lambda a, b: a & b, [left[f"`{c}`"].eqNullSafe(right[f"`{c}`"]) for c in cols])


def rank_select(df: DataFrame, strata: list[str], key: str, quotas: DataFrame,
                seed: int = 0, out: str = "selected", quota_col: str = "quota", tie: str | None = None) -> DataFrame:
    """Mark the first ``quota`` rows of every stratum in (hash(key), key) order.

    ``quotas``: (strata..., quota).  Strata without a quota select nothing; a
    NULL stratum is one like any other.  Equivalent to
    ``row_number() OVER (PARTITION BY strata ORDER BY h, key) <= quota``, but
    only one boundary (hash value, rows before it) per stratum is joined to
    the rows, and only rows of exactly that hash value are ranked.  The boundary
    is found in two steps, the range of hash values that holds it and the value
    itself, so that no task orders all values of a large stratum."""
    own = [_q(c).alias(c) for c in strata]
    h = df.withColumn("_h", hash_bucket(key, seed)).withColumn("_g", F.floor(F.col("_h") * F.lit(_RANGES) / F.lit(HASH_MOD)))

    def runs(order: str):
        return Window.partitionBy(*[_q(c) for c in strata]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    cnt = h.groupBy(*[_q(c) for c in strata], "_g").agg(F.count(F.lit(1)).alias("_c")).withColumn("_end", F.sum("_c").over(runs("_g")))
    q = quotas.select(*own, F.col(quota_col).alias("_quota"))
    cnt = cnt.join(q, _same(cnt, q, strata), "left").select(
        *[cnt[f"`{c}`"] for c in strata], "_g", "_c", "_end", F.coalesce("_quota", F.lit(0)).alias("_quota"))
    # the first range that does not fit whole; none where all rows are taken
    gate = (cnt.groupBy(*[_q(c) for c in strata], "_quota")
            .agg(F.min(F.when(F.col("_end") > F.col("_quota"), F.struct("_g", (F.col("_end") - F.col("_c")).alias("_before")))).alias("_gate"))
            .select(*own, "_quota", F.col("_gate._g").alias("_in"), F.col("_gate._before").alias("_before")))
    gate = few_rows(gate)
    fine = (h.join(gate, _same(h, gate, strata) & (h["_g"] == gate["_in"])).select(*[h[f"`{c}`"] for c in strata], "_h", "_quota", "_before")
            .groupBy(*[_q(c) for c in strata], "_h", "_quota", "_before").agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_end", F.col("_before") + F.sum("_c").over(runs("_h"))).withColumn("_start", F.col("_end") - F.col("_c")))
    # the first value that does not
    value = (fine.groupBy(*[_q(c) for c in strata])
             .agg(F.min(F.when(F.col("_end") > F.col("_quota"), F.struct("_h", "_start"))).alias("_edge")).select(*own, "_edge"))
    edge = gate.join(value, _same(gate, value, strata), "left").select(
        *[gate[f"`{c}`"].alias(c) for c in strata], "_quota", F.col("_edge._h").alias("_at"), F.col("_edge._start").alias("_start"))
    edge = few_rows(edge)   # a row a stratum: the rows of a stratum stay where they are
    j = h.join(edge, _same(h, edge, strata), "left").select(*[h[f"`{c}`"] for c in h.columns], "_quota", "_at", "_start")
    clear = j.where("_at is null or _h != _at").withColumn(out, F.expr("_at is null or _h < _at"))
    tied = j.where("_h = _at")
    wr = Window.partitionBy(*[_q(c) for c in strata], "_h").orderBy(_q(key), *([_q(tie)] if tie else []))
    tied = tied.withColumn(out, F.col("_start") + F.row_number().over(wr) <= F.col("_quota"))
    return clear.unionByName(tied).drop("_h", "_g", "_at", "_start", "_quota")


def stratum_counts(df: DataFrame, strata: list[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(df: DataFrame, key: str, strata: list[str], test_frac: float = 0.2,
                     seed: int = 0, names=("train", "test"), out: str = "split") -> DataFrame:
    """Per stratum, the first round(test_frac * n) rows in hash order are
    the test part (half rounds up)."""
    q = stratum_counts(df, strata).select(
        *strata, F.floor(F.col("n") * F.lit(test_frac) + F.lit(0.5)).cast("long").alias("quota"))
    sel = rank_select(df, strata, key, q, seed, "_test")
    return sel.withColumn(out, F.when(F.col("_test"), F.lit(names[1])).otherwise(F.lit(names[0]))) \
              .drop("_test")


def balanced_sample(df: DataFrame, key: str, label: str, minority, factor: float = 2.0,
                    seed: int = 0) -> DataFrame:
    """Every minority row plus floor(factor * n_minority) majority rows.
    Rows without a label are neither and take no part."""
    df = df.where(_q(label).isNotNull())
    n_min = df.where(_q(label) == F.lit(minority)).agg(F.count(F.lit(1)).alias("n_min"))
    tagged = df.withColumn("_is_min", _q(label) == F.lit(minority))
    q = n_min.select(F.lit(False).alias("_is_min"),
                     F.floor(F.col("n_min") * F.lit(factor)).cast("long").alias("quota")) \
             .unionByName(n_min.select(F.lit(True).alias("_is_min"), F.col("n_min").alias("quota")))
    sel = rank_select(tagged, ["_is_min"], key, q, seed, "_sel")
    return sel.where(F.col("_sel")).drop("_sel", "_is_min")


def oversample(df: DataFrame, key: str, label: str, seed: int = 0, out: str = "copy") -> DataFrame:
    """Replicate every non-majority class up to the majority count.
    A class with n rows and majority m gets m // n copies of each row, plus one
    extra copy for the first m % n rows in hash order.  Copies are numbered
    ``copy`` = 1..k (explode of a bounded sequence).  Rows without a label are
    no class and stay once."""
    named = df.where(_q(label).isNotNull())
    cnt = named.groupBy(_q(label)).agg(F.count(F.lit(1)).alias("_n"))
    cnt = cnt.withColumn("_m", cnt.select(F.max("_n")).scalar())
    cnt = cnt.withColumn("_q", F.floor(F.col("_m") / F.col("_n")).cast("long")) \
             .withColumn("quota", F.pmod(F.col("_m"), F.col("_n")).cast("long"))
    sel = rank_select(named, [label], key, cnt.select(label, "quota"), seed, "_extra")
    sel = sel.join(few_rows(cnt.select(label, "_q")), [label]).select(*[_q(c) for c in df.columns], "_q", "_extra")
    copies = F.col("_q") + F.col("_extra").cast("long")
    many = sel.withColumn(out, F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("_q", "_extra")
    return many.unionByName(df.where(_q(label).isNull()).withColumn(out, F.lit(1).cast("long")))


def balanced_bags(df: DataFrame, key: str, label: str, minority, bags: int = 3,
                  ratio: float = 1.0, seed: int = 100) -> DataFrame:
    """(bag, row) table; each bag holds every minority row and
    floor(ratio * n_minority) majority rows chosen by a per-bag hash.  Rows
    without a label are neither and take no part."""
    spark = df.sparkSession
    df = df.where(_q(label).isNotNull())
    n_min = df.where(_q(label) == F.lit(minority)).select(F.count(F.lit(1))).scalar()
    ids = F.sequence(F.lit(1), F.lit(bags))
    maj = df.where(~(_q(label) == F.lit(minority))).withColumn("bag", F.explode(ids))
    # per-bag ordering: hash of (key, bag), so every bag draws its own rows
    maj = maj.withColumn("_bk", key_number(_q(key)) * F.lit(BAG_STRIDE) + F.col("bag"))
    q = spark.range(1, bags + 1).select(F.col("id").cast("int").alias("bag"),
                                        F.floor(n_min * F.lit(ratio)).cast("long").alias("quota"))
    sel = rank_select(maj, ["bag"], "_bk", q, seed, "_sel", tie=key).where(F.col("_sel")).drop("_sel", "_bk")
    mins = df.where(_q(label) == F.lit(minority)).withColumn("bag", F.explode(ids))
    return sel.unionByName(mins)


def stage2_pool(df: DataFrame, split: str, label: str, train: str = "train",
                permit: str = "Tillatelse") -> DataFrame:
    """The true-permit rows of the training split."""
    return df.where((_q(split) == F.lit(train)) & (_q(label) == F.lit(permit)))
