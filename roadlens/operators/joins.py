"""Temporal and spatial joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.operators import scan as S
from roadlens.session import materialize


def lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with per-key values, at most one row per key.

    A plain equi-join: Spark broadcasts ``small`` where its measured size allows, and otherwise splits the
    partitions that it measures to be skewed, so a hot key does not fill one task and nothing is copied beforehand.
    """
    return df.join(small, list(keys), how)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    at: str,
    values: Sequence[str],
    *,
    right_at: str | None = None,
    right_order: str | None = None,
    direction: str = "nearest",
    tolerance: float | None = None,
    prefix: str = "",
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """For every left row the right row of the same ``by`` key closest in time.

    ``direction`` is ``backward`` (at or before), ``forward`` (at or after) or
    ``nearest``; a nearest tie goes to the earlier row. If several right rows
    share a time, the one with the smallest ``right_order`` counts. Left rows
    without a partner keep null values. Adds ``prefix + v`` for each value and
    ``prefix + 'at'``, the time of the partner.

    Both sides are merged into one ordered sequence and scanned once, so the
    cost is one sort of n + m rows and a hot key is split over many tasks.
    """
    by = list(by)
    right_at = right_at or at
    order = F.col(right_order) if right_order else F.lit(0)
    payload = F.struct(F.col(right_at).alias("at"), *[F.col(v).alias(v) for v in values])
    partner = (
        right.where(F.col(right_at).isNotNull())
        .groupBy(*by, F.col(right_at).alias("_t"))
        .agg(F.min_by(payload, order).alias("_payload"))
    )
    payload_type = partner.schema["_payload"].dataType
    # the merged rows get numbers of their own, those of the left side are kept aside
    own = [c for c in (S.SEQ, S.CHUNK) if c in left.columns]
    kept = left.withColumnsRenamed({c: f"_left{c}" for c in own})
    both = kept.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side")).withColumn(
        "_payload", F.lit(None).cast(payload_type)
    ).unionByName(partner.withColumn("_side", F.lit(0)), allowMissingColumns=True)

    specs = {}
    if direction in ("backward", "nearest"):
        specs["_prev"] = S.last_known("_payload")
    if direction in ("forward", "nearest"):
        specs["_next"] = S.next_known("_payload")
    # at equal times right rows come first, so a look back includes equality;
    # a pure look ahead needs the left rows first for the same reason
    side = F.col("_side").desc() if direction == "forward" else F.col("_side")
    seq = S.sequence(both, by, ["_t", side], chunk_bits)
    found = S.scan(seq, by, **specs).where("_side = 1")

    t = F.col(at)
    if direction == "backward":
        hit = F.col("_prev")
    elif direction == "forward":
        hit = F.col("_next")
    elif direction == "nearest":
        to_prev = t - F.col("_prev.at")
        to_next = F.col("_next.at") - t
        hit = F.when(F.col("_next").isNull() | (to_prev <= to_next), F.col("_prev")).otherwise(
            F.col("_next")
        )
    else:
        raise ValueError(f"unknown direction {direction!r}")
    if tolerance is not None:
        hit = F.when(F.abs(hit["at"] - t) <= tolerance, hit)
    found = found.withColumn("_hit", F.when(t.isNotNull(), hit))
    return found.select(
        *[F.col(f"_left{c}").alias(c) if c in own else F.col(c) for c in left.columns],
        *[F.col(f"_hit.{v}").alias(f"{prefix}{v}") for v in values],
        F.col("_hit.at").alias(f"{prefix}at"),
    )


def nearest_row(
    frames: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    at: str,
    target_at: str,
    *,
    exclude: Sequence[str] = (),
    adjacent: bool = False,
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """For each target the ``_seq`` of the frame closest in time.

    A tie goes to the earlier frame; with ``adjacent`` several frames of one earlier time give the last of
    them, the one next to the target. ``exclude`` names target columns with ``_seq`` values not to be used.
    Targets are the left side of an as-of scan: targets and frame times are put into one order and scanned once,
    so the cost is a sort of n + m narrow rows, whatever the trip sizes. With e excluded frames, a time carries the
    e + 1 frames next to it on either side, which always hold the answer. Targets of keys without frames are dropped.
    """
    keys = list(keys)
    ids, need = targets.columns, len(exclude) + 1
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    rows = frames.where(known & F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("_t"), F.col(S.SEQ).alias("_row"))

    def first(order: Column) -> Column:
        return F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(order))

    frame = F.struct(F.col("_t").alias("t"), F.col("_row").alias("row"))
    if need == 1:
        times = rows.groupBy(*keys, "_t").agg(F.array(F.min(frame)).alias("_next"), F.array((F.max if adjacent else F.min)(frame)).alias("_prev"))
    else:
        down = F.col("_row").desc() if adjacent else F.col("_row")
        few = rows.withColumns({"_a": first(F.col("_row")), "_z": first(down)}).where((F.col("_a") <= need) | (F.col("_z") <= need))
        gather = lambda c: F.collect_list(F.when(F.col(c) <= need, frame))  # noqa: E731  at most ``need`` frames
        times = S.sequence(few.groupBy(*keys, "_t").agg(gather("_a").alias("_next"), gather("_z").alias("_prev")), keys, ["_t"], chunk_bits)
        for _ in exclude:  # each pass hands the lists on by one more time
            times = S.scan(times, keys, _before=S.lag("_prev"), _after=S.lead("_next"))
            times = times.withColumns({
                "_prev": F.array_distinct(F.concat("_prev", F.coalesce("_before", F.slice("_prev", 1, 0)))),
                "_next": F.array_distinct(F.concat("_next", F.coalesce("_after", F.slice("_next", 1, 0)))),
            }).drop("_before", "_after")
        times = times.drop(S.SEQ, S.CHUNK)
    asked = targets.where(known & F.col(target_at).isNotNull()).distinct()
    marked = asked.select(*[F.col(c) if c in keys else F.col(c).alias(f"_id_{c}") for c in ids], F.col(target_at).cast("double").alias("_t"), F.lit(0).alias("_side"))
    # a target stands before the frames of its own time: what lies behind it is strictly earlier
    both = marked.unionByName(times.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    seq = S.sequence(both, keys, ["_t", "_side"], chunk_bits)
    found = S.scan(seq, keys, _prev=S.last_known("_prev"), _next=S.next_known("_next")).where("_side = 0")
    t = F.col("_t")

    def ranked(side: str, later: int) -> Column:
        place = (lambda f: -f["row"]) if adjacent and not later else (lambda f: f["row"])
        return F.coalesce(
            F.transform(side, lambda f: F.struct(F.abs(f["t"] - t).alias("gap"), F.lit(later).alias("later"), place(f).alias("place"), f["row"].alias("seq"))),
            F.array().cast("array<struct<gap:double,later:int,place:bigint,seq:bigint>>"),
        )

    choice = F.concat(ranked("_prev", 0), ranked("_next", 1))
    out = found.select(*[F.col(c) if c in keys else F.col(f"_id_{c}").alias(c) for c in ids], choice.alias("_choice"))
    free = F.filter("_choice", lambda f: reduce(lambda a, b: a & b, [~f["seq"].eqNullSafe(F.col(x)) for x in exclude], F.lit(True)))
    return out.select(*ids, F.array_min(free)["seq"].alias(S.SEQ)).where(F.col(S.SEQ).isNotNull())


#: Cells of the interval index are powers of four wide, from 4^FINEST on; the level after the last has one cell for all times.
FINEST, LEVELS = -6, 62


def _cell(t: Column, level: Column) -> Column:
    sizes = F.array(*[F.lit(4.0 ** (i + FINEST)) for i in range(LEVELS)])
    return F.when(level == LEVELS, F.lit(0).cast("long")).otherwise(F.floor(t.cast("double") / F.get(sizes, level)).cast("long"))


def interval_index(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """The intervals, written once, with ``_level`` and ``_cell``: the cells of their own level that they touch.

    The cells of an interval's level are at least as wide as the interval and less than four times so (very short ones share the
    finest level), so it touches one or two of them, whatever the lengths of the other intervals. Intervals that start after
    their end, or with a null end, are empty and left out; infinite ends are allowed.
    """
    length = F.col(end).cast("double") - F.col(start).cast("double")
    steps = F.when(length > 0, F.log2(length) / 2 - FINEST).otherwise(F.lit(0.0))
    level = F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(float(LEVELS)), steps))).cast("int")
    placed = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    low, high = (_cell(F.col(c), F.col("_level")) for c in (start, end))
    return materialize(placed.withColumn("_cell", F.sequence(low, high)), "intervals")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    *,
    closed: str = "both",
) -> DataFrame:
    """Pairs of points and intervals of the same key with the point inside.

    The intervals are indexed by :func:`interval_index`; a point asks one cell of each level that its key has, so a pair
    meets exactly once, a long trip spreads over many hash partitions, and an interval of unusual length costs as
    much as any other. Points of keys without intervals leave before the join. ``closed`` is ``both``, ``neither``, ``left`` or ``right``.
    """
    on = list(on)
    clash = [c for c in intervals.columns if c in points.columns and c not in on]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    index = interval_index(intervals, start, end)
    levels = index.groupBy(*on).agg(F.collect_set("_level").alias("_levels"))  # at most LEVELS + 1 numbers a key
    asked = lookup(points.where(F.col(at).isNotNull()), levels, on).withColumn("_level", F.explode("_levels")).drop("_levels")
    left = asked.withColumn("_cell", _cell(F.col(at), F.col("_level")))
    right = index.withColumn("_cell", F.explode("_cell"))
    after = F.col(at) >= F.col(start) if closed in ("both", "left") else F.col(at) > F.col(start)
    before = F.col(at) <= F.col(end) if closed in ("both", "right") else F.col(at) < F.col(end)
    return left.join(right, [*on, "_level", "_cell"]).where(after & before).drop("_level", "_cell")


def winning_interval(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    value: str,
    priority: str,
    *,
    closed: str = "both",
) -> DataFrame:
    """(keys, ``_seq``, value) of the interval with the highest priority around each point.

    Only points inside some interval are returned.
    """
    narrow = points.select(*on, S.SEQ, at)
    marks = intervals.select(*on, start, end, value, priority)
    hits = interval_join(narrow, marks, on, at, start, end, closed=closed)
    return hits.groupBy(*on, S.SEQ).agg(F.max_by(value, priority).alias(value))


def box_match(
    points: DataFrame,
    objects: DataFrame,
    on: Sequence[str],
    xy: tuple[str, str],
    object_xy: tuple[str, str],
    tolerance: float,
) -> DataFrame:
    """Point/object pairs with both coordinate differences within ``tolerance``.

    An equi-join on grid cells of size ``2 * tolerance``: an object has one cell,
    a point is offered to the (at most four) cells its box touches, then the
    exact box is tested. No pair is met twice.
    """
    cell = F.lit(2.0 * tolerance if tolerance > 0 else 1.0)
    x, y = F.col(xy[0]), F.col(xy[1])
    ox, oy = F.col(object_xy[0]), F.col(object_xy[1])
    tol = F.lit(float(tolerance))
    # the cell range is widened by a hair so rounding in the division loses no pair
    eps = F.lit(1e-9)

    def cells(v: Column) -> Column:
        lo = F.floor((v - tol) / cell - eps).cast("long")
        hi = F.floor((v + tol) / cell + eps).cast("long")
        return F.explode(F.sequence(lo, hi))

    near = points.where(x.isNotNull() & y.isNotNull()).withColumn("_cx", cells(x)).withColumn("_cy", cells(y))
    placed = objects.select(
        "*", F.floor(ox / cell).cast("long").alias("_cx"), F.floor(oy / cell).cast("long").alias("_cy")
    )
    joined = near.join(placed, [*on, "_cx", "_cy"])
    return joined.where((F.abs(ox - x) <= tol) & (F.abs(oy - y) <= tol)).drop("_cx", "_cy")
