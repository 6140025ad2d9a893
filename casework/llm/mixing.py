"""Mixing sources to target weights by hierarchical budgeting (operator 9, native).

Three levels, domain - language - source, each with its own weights.  Every
node can give at most ``max_epochs`` times its tokens.  Going down from the
root, the budget of a node is shared among its children in proportion to their
weights; a child that cannot use its share passes the rest to its siblings, and
only what all of them together cannot use reaches the parent's siblings
(the node's capacity bounds what its parent gives it).

A leaf with budget q and t tokens gives every document ``q div t`` times; the
rest comes from the next epoch: the longest prefix, in that epoch's seeded
order, whose tokens fit.  The order key is ``md5(seed:epoch:doc_id)``.

Nothing but DataFrame functions runs here.  The prefix of a leaf is found from
token sums of 4096 ranges of the key; only the one range that holds the cut is
summed row by row, so a leaf with a third of all rows is no single task.  The
texts are read once, to count tokens; the choice itself is a comparison with
one cut for each leaf.

Defined results: null language or source form the leaf ``(none)``; a null or
empty text has no tokens and costs nothing; rows with the same doc_id in a leaf
are taken together; a leaf with weight 0 or without tokens gives nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("_domain", "_lang", "_source")
#: hex digits of the order key that name a range: 16^3 ranges for each leaf
_DIGITS = 3


def domain_of(source: Column) -> Column:
    """The domain of a source: its number's third of the twenty sources."""
    n = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    return (F.when(n.isNull(), "other").when(n < 7, "web").when(n < 14, "reference").otherwise("forum"))


def _weight(of: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(None).cast("long")
    if table:
        lits = [x for k, v in table.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
        out = F.element_at(F.create_map(*lits), of)
    return F.coalesce(out, F.lit(int(default)).cast("long"))


def share(children: DataFrame, parent: list[str], order: str) -> DataFrame:
    """``give``: what each child gets of its parent's ``have``.

    Children have ``cap`` and ``w``.  Sorted by cap / w, a child is full if its
    capacity is within its share of what the children before it left; from the
    first that is not, all share in proportion to weight.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    return (children.where("w > 0 and cap > 0")
            .withColumn("_left", F.col("have") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("_w", F.sum("w").over(after))
            .withColumn("_full", F.col("cap") * F.col("_w") <= F.col("_left") * F.col("w"))
            .withColumn("_i", F.row_number().over(by))
            .withColumn("_first", F.min(F.when(~F.col("_full"), F.struct("_i", "_left", "_w"))).over(every))
            .withColumn("give", F.expr("case when _first is null or _i < _first._i then cap "
                                       "else (_first._left * w) div _first._w end"))
            .drop("_left", "_w", "_full", "_i", "_first"))


def budgets(leaves: DataFrame, weights: dict, budget: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves`` (``LEVELS``, ``tokens``) with ``give``, the tokens to take.

    ``weights``: for ``domain``, ``lang`` and ``source`` a table of whole
    numbers and, under ``default``, the weight of names not in it.
    ``budget``: the tokens to take, as a fraction (numerator, denominator) of all.
    """
    d, l, s = LEVELS
    w = {k: (weights.get(k) or {}, (weights.get("default") or {}).get(k, 1)) for k in ("domain", "lang", "source")}
    leaf = leaves.withColumn("cap", F.col("tokens") * int(max_epochs))
    total = leaves.agg(F.expr(f"coalesce((sum(tokens) * {int(budget[0])}) div {int(budget[1])}, 0)").alias("t")).scalar()
    top = (leaf.groupBy(d).agg(F.sum("cap").alias("cap"))
           .withColumn("w", _weight(F.col(d), *w["domain"])).withColumn("have", total)
           .withColumn("_root", F.lit(0)))
    top = share(top, ["_root"], d).select(d, F.col("give").alias("have"))
    mid = (leaf.groupBy(d, l).agg(F.sum("cap").alias("cap"))
           .withColumn("w", _weight(F.col(l), *w["lang"])).join(top, d))
    mid = share(mid, [d], l).select(d, l, F.col("give").alias("have"))
    low = leaf.withColumn("w", _weight(F.col(s), *w["source"])).join(mid, [d, l])
    return share(low, [d, l], s).select(*LEVELS, "tokens", "give")


def mix(docs: DataFrame, weights: dict, budget: tuple[int, int] = (3, 4), max_epochs: int = 2,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", epoch_col: str | None = "epoch",
        domain_col: str | None = None) -> DataFrame:
    """``docs``, each row once for each epoch it is taken in.

    ``epoch_col`` and ``domain_col`` name added columns (None: not added); a
    column of ``docs`` with that name is replaced, all others stay whatever
    their names.
    """
    drop = {epoch_col, domain_col} - {None}
    keep = [c for c in docs.columns if c not in drop]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("(none)"))
    # a document travels as one column, so its names cannot meet ours
    tagged = (docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), source.alias("_source"),
                          F.coalesce(F.col(lang_col).cast("string"), F.lit("(none)")).alias("_lang"),
                          F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                          F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
              .withColumn("_domain", domain_of(F.col("_source"))))
    narrow = materialize(tagged.select(*LEVELS, "_id", "n"))
    quota = budgets(narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), weights, budget, max_epochs)
    # one row for each leaf; small, so Spark broadcasts it by its size
    quota = materialize(quota.where("give > 0").select(
        *LEVELS, F.expr("give div tokens").alias("_full"), F.expr("give % tokens").alias("_rest")))

    def keyed(df):
        return (df.join(quota, list(LEVELS))
                .withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full"), F.col("_id")).cast("binary")))
                .withColumn("_range", F.substring("_key", 1, _DIGITS)))

    rows = keyed(narrow)
    sums = (rows.groupBy(*LEVELS, "_range", "_rest").agg(F.sum("n").alias("n"))
            .withColumn("_upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("_range"))))
    cut_range = (sums.where("_upto > _rest").groupBy(*LEVELS)
                 .agg(F.min(F.struct("_range", (F.col("_upto") - F.col("n")).alias("_before"))).alias("_cut"))
                 .select(*LEVELS, F.col("_cut._range").alias("_at"), F.col("_cut._before").alias("_before")))
    inside = (rows.join(cut_range, list(LEVELS)).where("_range = _at")
              .withColumn("_sum", F.col("_before") + F.sum("n").over(
                  Window.partitionBy(*LEVELS).orderBy("_key", "_id")))   # a range frame: ties are taken together
              .where("_sum <= _rest").groupBy(*LEVELS)
              .agg(F.max(F.struct("_key", "_id")).alias("_last")))
    cuts = materialize(quota.join(cut_range, list(LEVELS), "left").join(inside, list(LEVELS), "left")
                       .select(*LEVELS, "_full", "_rest", "_at", "_last"))
    taken = (tagged.join(cuts, list(LEVELS))
             .withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full"), F.col("_id")).cast("binary")))
             .withColumn("_range", F.substring("_key", 1, _DIGITS))
             .withColumn("_times", F.col("_full") + F.expr(
                 "case when _rest = 0 then 0L when _range < _at then 1L "
                 "when _range = _at and struct(_key, _id) <= _last then 1L else 0L end")))
    out = taken.where("_times > 0").withColumn("_epoch", F.explode(F.expr("sequence(0, cast(_times as int) - 1)")))
    extra = [F.col("_epoch").alias(epoch_col)] if epoch_col else []
    extra += [F.col("_domain").alias(domain_col)] if domain_col else []
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in keep], *extra)
