"""Geometry and motion columns on the shipped tables, at line-item scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.functions import geometry as G
from roadlens.operators import joins as J
from roadlens.sources import shipped as D

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_IDS = ", ".join(_ID)
_V = "speed / 3.6 * cos(radians(yaw)) AS vx, speed / 3.6 * sin(radians(yaw)) AS vy, ox - x AS rx, oy - y AS ry, sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y)) AS d"


def _ttc(spark, sf, column):
    return D.motion(spark, sf).select(*_ID, F.round(column, 6).alias("ttc"))


_ARGS = ("x", "y", "speed", "yaw", "ox", "oy", "ovx", "ovy")


@query(
    "ttc_static",
    f"""WITH {D.MOTION_SQL}, v AS (SELECT *, {_V} FROM motion)
SELECT {_IDS}, round(CASE WHEN d < 1e-6 THEN 0 WHEN (rx * vx + ry * vy) / d > 0.5 THEN d / ((rx * vx + ry * vy) / d) END, 6) AS ttc FROM v""",
)
def ttc_static(spark, sf):
    return _ttc(spark, sf, G.ttc_static(*[F.col(c) for c in _ARGS[:6]]))


@query(
    "ttc_range_rate",
    f"""WITH {D.MOTION_SQL}, v AS (SELECT *, {_V} FROM motion),
c AS (SELECT *, -(rx * (ovx - vx) + ry * (ovy - vy)) / d AS closing FROM v)
SELECT {_IDS}, round(CASE WHEN d < 1e-6 THEN 0 WHEN closing > 0.5 THEN d / closing END, 6) AS ttc FROM c""",
)
def ttc_range_rate(spark, sf):
    return _ttc(spark, sf, G.ttc_range_rate(*[F.col(c) for c in _ARGS]))


@query(
    "ttc_quadratic",
    f"""WITH {D.MOTION_SQL}, v AS (SELECT *, {_V} FROM motion),
q AS (SELECT *, (ovx - vx) * (ovx - vx) + (ovy - vy) * (ovy - vy) AS a, 2 * (rx * (ovx - vx) + ry * (ovy - vy)) AS b, rx * rx + ry * ry - 4 AS c FROM v),
s AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 AND a >= 1e-8 THEN sqrt(b * b - 4 * a * c) END AS root FROM q)
SELECT {_IDS}, round(CASE WHEN c <= 0 THEN 0 WHEN root IS NULL THEN NULL
  WHEN (-b - root) / (2 * a) > 1e-8 THEN (-b - root) / (2 * a) WHEN (-b + root) / (2 * a) > 1e-8 THEN (-b + root) / (2 * a) END, 6) AS ttc FROM s""",
)
def ttc_quadratic(spark, sf):
    return _ttc(spark, sf, G.ttc_quadratic(*[F.col(c) for c in _ARGS]))


@query(
    "ttc_generic",
    f"""WITH {D.MOTION_SQL}, v AS (SELECT *, {_V} FROM motion),
m AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'static' WHEN 2 THEN 'same_direction' WHEN 3 THEN 'opposite_direction' WHEN 4 THEN 'crossing' ELSE 'other' END AS mv FROM v),
r AS (SELECT *, CASE mv WHEN 'static' THEN speed / 3.6 WHEN 'crossing' THEN speed / 3.6 WHEN 'same_direction' THEN greatest(speed / 3.6 - l_suppkey / 3.6, 0)
   WHEN 'opposite_direction' THEN speed / 3.6 + l_suppkey / 3.6 END AS rel FROM m)
SELECT {_IDS}, round(CASE WHEN d > 0 AND rel > 0.5 THEN d / rel END, 6) AS ttc FROM r""",
)
def ttc_generic(spark, sf):
    """Distance over relative speed in the four ways an object can move."""
    n = F.col("l_linenumber")
    move = F.when(n == 1, "static").when(n == 2, "same_direction").when(n == 3, "opposite_direction").when(n == 4, "crossing").otherwise("other")
    gap = G.planar(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    return _ttc(spark, sf, G.ttc_generic(gap, F.col("speed"), F.col("l_suppkey"), move))


@query(
    "line_distance",
    f"""WITH {D.MOTION_SQL}, l AS (SELECT *, ovx * 10 - ox AS dx, ovy * 10 - oy AS dy FROM motion),
n AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM l)
SELECT {_IDS}, round(CASE WHEN len < 1e-9 THEN sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) ELSE (dx * (y - oy) - dy * (x - ox)) / len END, 6) AS signed,
  round(abs(CASE WHEN len < 1e-9 THEN sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) ELSE (dx * (y - oy) - dy * (x - ox)) / len END), 6) AS distance FROM n""",
)
def line_distance(spark, sf):
    args = [F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.col("ovx") * 10, F.col("ovy") * 10]
    return D.motion(spark, sf).select(
        *_ID, F.round(G.signed_line_distance(*args), 6).alias("signed"), F.round(G.line_distance(*args), 6).alias("distance")
    )


@query(
    "haversine",
    f"""WITH {D.MOTION_SQL}, r AS (SELECT *, radians(x) AS a1, radians(oy) AS a2, radians(ox - y) AS dl FROM motion)
SELECT {_IDS}, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(oy - x) / 2), 2) + cos(a1) * cos(a2) * pow(sin(dl / 2), 2)))), 3) AS metres FROM r""",
)
def haversine(spark, sf):
    return D.motion(spark, sf).select(
        *_ID, F.round(G.haversine(F.col("x"), F.col("y"), F.col("oy"), F.col("ox")), 3).alias("metres")
    )


@query(
    "tolerance_match",
    f"""WITH {D.MOTION_SQL}, p AS (SELECT n_nationkey, n_regionkey AS r, n_nationkey * 4.25 AS px, n_regionkey * 10.25 AS py FROM nation),
o AS (SELECT l_suppkey % 5 AS r, x, y, l_partkey FROM motion)
SELECT n_nationkey, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM p JOIN o ON p.r = o.r
 AND abs(x - px) <= 0.75 AND abs(y - py) <= 0.75 GROUP BY n_nationkey""",
)
def tolerance_match(spark, sf):
    """Nations as points, line items as objects: both coordinates within the tolerance."""
    p = D.table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_regionkey").cast("long").alias("r"), (F.col("n_nationkey") * 4.25).alias("px"), (F.col("n_regionkey") * 10.25).alias("py")
    )
    o = D.motion(spark, sf).select((F.col("l_suppkey") % 5).alias("r"), "x", "y", "l_partkey")
    hits = J.box_match(p, o, ["r"], ("px", "py"), ("x", "y"), 0.75)
    # objects first, so one crowded box never holds all its rows
    per = hits.groupBy("n_nationkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("n_nationkey").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("parts"))
