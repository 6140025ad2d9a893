"""Road-attribute enrichment.

C4 keeps the first object per reference with a hash aggregate (``min_by`` on
an explicit order) instead of a window, so a reference with many objects is
reduced map-side.  C5 counts points within a radius along the same road by
running sums: count = S(<= m + r) - S(< m - r).  Points and cases of a road are
exchanged together once and sorted; roads that may be too long for one task go
through ``prefix_sums``, once per distinct (road, meter) and joined back.  No
case x point pairs exist at any stage, so a dense road segment costs a sort,
not a quadratic join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.functions.derive import first_property, road_meter, road_part
from casework.operators.quantile import prefix_sums
from casework.session import materialize


#: keys are counted together in so many groups, by hash
_KEY_GROUPS = 1 << 14
#: the keys of a group with up to so many rows are sorted in one task each
_KEY_ROWS = 1 << 20


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def object_points(objects: DataFrame, object_type: int | None = None) -> DataFrame:
    """Road objects -> one (road, meter) row per location reference.
    An object with k references yields k points."""
    o = objects if object_type is None else objects.where(F.col("object_type") == object_type)
    return o.select("object_id", F.explode("references").alias("r")).select(
        "object_id", F.col("r.road").alias("road"), F.col("r.meter").alias("meter"))


def first_object(objects: DataFrame, key: str, order: str, value: str, out: str | None = None) -> DataFrame:
    """First object per reference by ``order`` (map-side reducible aggregate)."""
    return objects.where(_q(key).isNotNull()).groupBy(_q(key)).agg(
        F.min_by(_q(value), _q(order)).alias(out or value))


def lookup_attribute(cases: DataFrame, objects: DataFrame, case_key: str, obj_key: str,
                     order: str, prop: str | dict[str, str], out: str | None = None,
                     default: str = "") -> DataFrame:
    """Property ``prop`` of the first object on the case's key, as
    column ``out``, or several of the same object ({column: property}) in one
    join; no object or no such property -> ``default``."""
    wanted = prop if isinstance(prop, dict) else {out or prop: prop}
    first = first_object(objects.select(obj_key, order, "properties"), obj_key, order, "properties", "_props")
    attr = first.select(_q(obj_key).alias("_okey"), *[first_property("_props", p, default).alias(c) for c, p in wanted.items()])
    j = cases.join(attr, _q(case_key) == F.col("_okey"), "left").drop("_okey")
    return j.withColumns({c: F.coalesce(_q(c), F.lit(default)) for c in wanted})


def _with_exact_bound(df: DataFrame, m: str, r: float, upper: bool, out: str) -> DataFrame:
    """Adds ``out`` = the extreme double x with ``abs(x - m) <= r`` evaluated
    in floating point (upper: largest x, else smallest x).

    ``x - m`` rounds monotonically in x, so that set is an interval whose end
    lies within a few ulps of ``m + r`` (``m - r``).  The candidates ``t + k u``
    step by half an ulp over that neighbourhood, k = -8..8, and the last one that
    still passes is found by halving, so the count of points up to it equals a
    direct ``abs`` test.  Every step is a column of its own and none can be
    null, which keeps the generated method short: one of more than 8000 bytes is
    interpreted, and then takes tens of microseconds a row."""
    x = F.coalesce(F.col(m), F.lit(float("nan")))
    d = df.withColumn("_x", x).withColumn("_t", F.col("_x") + F.lit(r if upper else -r)).withColumn(
        "_u", F.coalesce(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(F.col("_t")) + F.lit(1e-300))) - F.lit(53.0)), F.lit(0.0)))
    side = 1.0 if upper else -1.0

    def inside(k):
        return F.lit(side) * (F.col("_t") + k * F.col("_u") - F.col("_x")) <= F.lit(r)
    d = d.withColumn("_k", F.lit(-8.0 * side))
    for step in (8.0, 4.0, 2.0, 1.0, 1.0):
        further = F.col("_k") + F.lit(step * side)
        d = d.withColumn("_k", F.when(inside(further), further).otherwise(F.col("_k")))
    end = F.col("_t") + F.col("_k") * F.col("_u")
    return d.withColumn("_end", end).withColumn(out, F.when(F.abs(F.col("_end") - F.col("_x")) <= F.lit(r), F.col("_end"))).drop(
        "_x", "_t", "_u", "_k", "_end")


def _key_group(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_KEY_GROUPS)).cast("int")


def _long_groups(*keys: DataFrame) -> list[int]:
    """The groups of keys with more than ``_KEY_ROWS`` rows in one of the tables (each of one column)."""
    found = set()
    for k in keys:
        n = k.where(_q(k.columns[0]).isNotNull()).groupBy(_key_group(_q(k.columns[0])).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        found |= {r.g for r in n.where(F.col("n") > _KEY_ROWS).collect()}  # at most _KEY_GROUPS numbers
    return sorted(found)


def count_within(cases: DataFrame, points: DataFrame, case_key: str, case_pos: str,
                 point_key: str, point_pos: str, radius: float = 500.0, out: str = "n_within",
                 bucket_width: float | None = None) -> DataFrame:
    """For every case row, the number of points on the same key whose
    position x satisfies ``abs(x - pos) <= radius`` (inclusive, in floating
    point: the interval ends are found exactly, see ``_with_exact_bound``).  Cases with a
    missing key or position, or no points, get 0.  Points with a NULL position
    never count.  Keys are counted first, in groups: those of groups with many rows
    are spread over tasks by position (``_count_in_buckets``), all others are
    sorted key by key (``_count_by_key``)."""
    long = _long_groups(cases.select(_q(case_key)), points.select(_q(point_key)))
    placed = _q(case_key).isNotNull() & _q(case_pos).isNotNull()
    none = cases.where(~placed).withColumn(out, F.lit(0).cast("long"))
    parts = [(cases.where(placed), points, _count_by_key)]
    if long:
        far, off = _key_group(_q(case_key)).isin(long), _key_group(_q(point_key)).isin(long)
        parts = [(cases.where(placed & ~far), points.where(~off), _count_by_key),
                 (cases.where(placed & far), points.where(off), _count_in_buckets)]
    for mine, pts, count in parts:
        none = none.unionByName(count(mine, pts, case_key, case_pos, point_key, point_pos, radius, out, bucket_width))
    return none


def _count_by_key(cases: DataFrame, points: DataFrame, case_key: str, case_pos: str, point_key: str, point_pos: str,
                  radius: float, out: str, bucket_width: float | None) -> DataFrame:
    """``count_within`` of keys whose rows fit one task: points and case rows
    are exchanged by key once; there a case becomes its two bounds, the running
    count of points is read at both, and they meet again at the case's position."""
    row = F.struct(*[_q(c) for c in cases.columns])
    c = cases.select(_q(case_key).alias("_key"), _q(case_pos).cast("double").alias("_m"), row.alias("_row"))
    # before the exchange, apart from the rows' events: short generated methods
    c = _with_exact_bound(c, "_m", radius, True, "_hi")
    c = _with_exact_bound(c, "_m", radius, False, "_lo")
    p = (points.select(_q(point_key).alias("_key"), _q(point_pos).cast("double").alias("_m"))
         .where(F.col("_key").isNotNull() & F.col("_m").isNotNull()))
    u = p.unionByName(c, allowMissingColumns=True).repartition("_key").withColumn("_point", F.col("_row").isNull())
    # a bound below sorts before points at the same place, one above after them
    def event(pos, tie, own):
        return F.struct(pos.alias("_pos"), F.lit(tie).alias("_tie"), own.alias("_own"))
    nothing = F.lit(None).cast(c.schema["_row"].dataType)
    events = F.when(F.col("_point"), F.array(event(F.col("_m"), 1, nothing))).otherwise(
        F.array(event(F.col("_lo"), 0, nothing), event(F.col("_hi"), 2, F.col("_row"))))
    e = u.select("_key", "_m", F.explode(events).alias("_e")).select("_key", "_m", "_e.*")
    upto = Window.partitionBy("_key").orderBy("_pos", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_n", F.count_if(F.col("_tie") == 1).over(upto)).where("_tie <> 1")
    at = Window.partitionBy("_key", "_m").orderBy("_tie").rowsBetween(Window.unboundedPreceding, 0)
    # no bounds: no point is within the radius, as of a position that is no number
    n = F.when(F.col("_pos").isNull(), 0).otherwise(F.col("_n") - F.first("_n").over(at)).cast("long")
    return e.select("_tie", F.col("_own").alias("_row"), n.alias("_within")).where("_tie = 2").select("_row.*", F.col("_within").alias(out))


def _count_in_buckets(cases: DataFrame, points: DataFrame, case_key: str, case_pos: str, point_key: str, point_pos: str,
                      radius: float, out: str, bucket_width: float | None) -> DataFrame:
    """``count_within`` of keys of any length.  The sort buckets default to radius / 8: a dense stretch of
    one road is spread over more window partitions, while the per-bucket
    offset table stays small (one row per non-empty bucket)."""
    bw = bucket_width or radius / 8.0
    pts = (points.select(_q(point_key).alias("_key"), _q(point_pos).cast("double").alias("_pos"))
           .where(F.col("_key").isNotNull() & F.col("_pos").isNotNull())
           .groupBy("_key", "_pos").agg(F.count(F.lit(1)).cast("double").alias("_w")))
    q = (cases.select(_q(case_key).alias("_key"), _q(case_pos).cast("double").alias("_m"))
         .where(F.col("_key").isNotNull() & F.col("_m").isNotNull()).distinct())
    q = _with_exact_bound(q, "_m", radius, True, "_hi")
    q = _with_exact_bound(q, "_m", radius, False, "_lo")
    bounds = q.select("_key", "_m", F.explode(F.array(
        F.struct(F.col("_hi").alias("_pos"), F.lit(False).alias("_strict"), F.lit(1).alias("_sign")),
        F.struct(F.col("_lo").alias("_pos"), F.lit(True).alias("_strict"),
                 F.lit(-1).alias("_sign")))).alias("b")).select(
        "_key", "_m", "b._pos", "b._strict", "b._sign")
    bounds = bounds.withColumn("_qid", F.struct("_key", "_m", "_sign"))
    ps = prefix_sums(pts, bounds, ["_key"], "_pos", ["_w"], "_qid", strict="_strict",
                     bucket_width=bw)
    cnt = ps.groupBy(F.col("_qid._key").alias("_key"), F.col("_qid._m").alias("_m")).agg(
        F.sum(F.col("_w") * F.col("_qid._sign")).cast("long").alias(out))
    j = cases.join(cnt, (_q(case_key) == F.col("_key")) &
                   (_q(case_pos).cast("double") == F.col("_m")), "left").drop("_key", "_m")
    return j.withColumn(out, F.coalesce(_q(out), F.lit(0).cast("long")))


def count_within_ref(cases: DataFrame, points: DataFrame, ref_col: str = "road_ref",
                     radius: float = 500.0, out: str = "n_within") -> DataFrame:
    """C5 on linear references: parse the case reference (B28) into road part
    and meter, then count points (road, meter) within ``radius``."""
    c = cases.withColumn("_road", road_part(ref_col)).withColumn("_meter", road_meter(ref_col))
    return count_within(c, points, "_road", "_meter", "road", "meter", radius, out).drop(
        "_road", "_meter")


# Elementary intervals in one block, as a power of two: an extent is kept as
# nodes of at most so many levels and as whole blocks.
_BLOCK_LEVEL = 8


def _places(positions: DataFrame, ends: DataFrame) -> DataFrame:
    """(_road, _pos, _unit) for distinct positions: the number of ends below
    plus the number at or below.  Ends get odd numbers in their order along
    the road, positions between two ends the even number between theirs."""
    asked = positions.select("_road", "_pos", F.explode(F.array(F.lit(True), F.lit(False))).alias("_strict")) \
                     .withColumn("_qid", F.struct("_road", "_pos", "_strict"))
    below = prefix_sums(ends.withColumn("_n", F.lit(1.0)), asked, ["_road"], "_pos", ["_n"], "_qid", strict="_strict")
    return below.groupBy(F.col("_qid._road").alias("_road"), F.col("_qid._pos").alias("_pos")).agg(
        F.sum("_n").cast("long").alias("_unit"))


def first_extent(extents: DataFrame, positions: DataFrame) -> DataFrame:
    """(_road, _m, _best): the smallest ``_best`` of the ``extents`` (_road,
    _from, _to, _best) that hold a position (_road, _m), both ends included;
    positions outside all extents have no row.

    The ends of a road cut it into elementary intervals, numbered in order
    (``_places``), so that an extent is a range of numbers however long it is.
    The range is taken apart into aligned nodes of 1, 2, 4, ... numbers, at
    most two of a size; equal nodes meet in a ``min``, and nodes above a block
    (256 numbers) go to their blocks after that, so one key never holds more
    than a block.  An interval finds its first object in its nodes up to the
    block; each is looked up once, for all positions in it."""
    spans = (extents.where("_road is not null and _from <= _to and not isnan(_from) and not isnan(_to)")
             .select("_road", F.col("_from").cast("double").alias("_from"), F.col("_to").cast("double").alias("_to"), "_best")
             .groupBy("_road", "_from", "_to").agg(F.min("_best").alias("_best")))
    ends = spans.select("_road", F.explode(F.array("_from", "_to")).alias("_pos")).distinct()
    at = (positions.where("_road is not null and _m is not null and not isnan(_m)")
          .select("_road", F.col("_m").cast("double").alias("_pos")).distinct())
    units = materialize(_places(ends.unionByName(at).distinct(), ends))
    ranges = (spans.join(units.select("_road", F.col("_pos").alias("_from"), F.col("_unit").alias("_a")), ["_road", "_from"])
              .join(units.select("_road", F.col("_pos").alias("_to"), F.col("_unit").alias("_z")), ["_road", "_to"]))
    # size 2^l: the range holds the nodes [lo, hi); the outer ones of odd rank have no larger parent in it
    sized = (ranges.withColumn("_l", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.expr("_z - _a + 1D"))).cast("int"))))
             .withColumn("_lo", F.expr("shiftright(_a + shiftleft(1L, _l) - 1, _l)"))
             .withColumn("_hi", F.expr("shiftright(_z + 1, _l)")).where("_lo < _hi"))
    nodes = (sized.select("_road", "_l", "_best", F.explode(F.expr(
        "filter(array(if(_lo % 2 = 1, _lo, null), if(_hi % 2 = 1, _hi - 1, null)), x -> x is not null)")).alias("_k"))
        .groupBy("_road", "_l", "_k").agg(F.min("_best").alias("_best")))
    up = F.expr(f"greatest(_l - {_BLOCK_LEVEL}, 0)")
    held = (nodes.withColumn("_up", up)
            .select("_road", F.least("_l", F.lit(_BLOCK_LEVEL)).alias("_l"), "_best", F.explode(F.expr(
                "sequence(shiftleft(_k, _up), shiftleft(_k + 1, _up) - 1)")).alias("_k"))
            .groupBy("_road", "_l", "_k").agg(F.min("_best").alias("_best")))
    mine = at.join(units, ["_road", "_pos"])
    firsts = (mine.select("_road", "_unit").distinct()
              .withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(_BLOCK_LEVEL)))).withColumn("_k", F.expr("shiftright(_unit, _l)"))
              .join(held, ["_road", "_l", "_k"]).groupBy("_road", "_unit").agg(F.min("_best").alias("_best")))
    return mine.join(firsts, ["_road", "_unit"]).select("_road", F.col("_pos").alias("_m"), "_best")


def lookup_by_reference(cases: DataFrame, objects: DataFrame, object_type: int,
                        prop: str | dict[str, str], out: str | None = None, ref_col: str = "road_ref",
                        default: str = "") -> DataFrame:
    """C4 on a road-object snapshot: properties of the first object (by
    ``ord``, then by value) of ``object_type`` at the case's reference - on the same road, and
    at the case's meter: there, or (``meter_to``) from before it to beyond it.
    A reference without a meter means the whole road.  None -> ``default``.
    Objects without ``ord`` have no place in the order and are left out.

    Only the wanted properties travel.  Extents of any length go through
    ``first_extent``; each distinct (road, meter) is looked up once."""
    wanted = prop if isinstance(prop, dict) else {out or prop: prop}
    o = objects.where((F.col("object_type") == object_type) & F.col("ord").isNotNull())
    has_end = "meter_to" in o.schema["references"].dataType.elementType.names
    values = [first_property("properties", p, default).alias(f"_v{i}") for i, p in enumerate(wanted.values())]
    refs = o.select("ord", *values, F.explode("references").alias("r")).select(
        F.col("r.road").alias("_road"), F.col("r.meter").alias("_from"),
        (F.coalesce("r.meter_to", "r.meter") if has_end else F.col("r.meter")).alias("_to"),
        F.struct("ord", *[f"_v{i}" for i in range(len(values))]).alias("_best"))
    at = cases.select(road_part(ref_col).alias("_road"), road_meter(ref_col).alias("_m")).distinct()
    there = first_extent(refs, at.where("_m is not null"))
    roads = at.where("_m is null").join(refs.groupBy("_road").agg(F.min("_best").alias("_best")), "_road")
    found = there.unionByName(roads.select("_road", "_m", "_best")).select(
        F.col("_road").alias("_r"), F.col("_m").alias("_rm"), *[F.col(f"_best._v{i}").alias(c) for i, c in enumerate(wanted)])
    c = cases.withColumn("_road", road_part(ref_col)).withColumn("_m", road_meter(ref_col))
    j = c.join(found, (F.col("_road") == F.col("_r")) & F.col("_m").eqNullSafe(F.col("_rm")), "left")
    return j.drop("_road", "_m", "_r", "_rm").withColumns({x: F.coalesce(_q(x), F.lit(default)) for x in wanted})


def application_type(cases: DataFrame, overrides: DataFrame, decision: str = "decision",
                     url: str = "archive_url", out: str = "application_type",
                     reject: str = "Avslag") -> DataFrame:
    """The application type starts as the decision; rejected cases are
    blank unless the override table (archive_url, application_type) names
    their type.  Spark broadcasts the override table if its size allows."""
    ov = overrides.select(F.col("archive_url").alias("_url"),
                          F.col("application_type").alias("_ov")).dropDuplicates(["_url"])
    j = cases.join(ov, F.col(url) == F.col("_url"), "left")
    val = F.when(F.col(decision) == F.lit(reject), F.coalesce(F.col("_ov"), F.lit(""))) \
           .otherwise(F.col(decision))
    return j.withColumn(out, val).drop("_url", "_ov")
