"""Ordered scans and temporal joins on the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.functions import text as T
from roadlens.operators import events as E
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators import trips as TR
from roadlens.sources import shipped as D

K = ["trip"]
W = "WINDOW w AS (PARTITION BY trip ORDER BY t, ord)"


@query(
    "run_elapsed",
    f"""WITH {D.FRAMES_SQL},
p AS (SELECT *, lag(label) OVER w AS before FROM frames {W}),
s AS (SELECT *, CASE WHEN label <> 'signup' AND (before IS NULL OR before = 'signup' OR before <> label)
      THEN t END AS b FROM p)
SELECT trip, ord, label, CASE WHEN label <> 'signup' THEN
  round(t - last_value(b IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) END AS elapsed FROM s""",
)
def run_elapsed(spark, sf):
    """Time since the current run of one label began; sign-ups count as no event."""
    f = D.ordered_frames(spark, sf, "label")
    out = E.run_elapsed(f, keys=K, clock="t", label="label", valid=F.col("label") != "signup", out="elapsed")
    return out.select("trip", "ord", "label", F.round("elapsed", 6).alias("elapsed"))


@query(
    "ffill_state",
    f"""WITH {D.FRAMES_SQL}
SELECT trip, ord, last_value(CASE WHEN label IN ('click','view','purchase') THEN label END IGNORE NULLS)
  OVER (PARTITION BY trip ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
FROM frames""",
)
def ffill_state(spark, sf):
    f = D.ordered_frames(spark, sf, "label")
    state = F.when(F.col("label").isin("click", "view", "purchase"), F.col("label"))
    return S.scan(f, K, state=S.last_known(state)).select("trip", "ord", "state")


@query(
    "prefix_backfill",
    f"""WITH {D.FRAMES_SQL},
s AS (SELECT *, CASE WHEN label IN ('click','view','purchase') THEN label END AS st FROM frames),
f AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
      first_value(st IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head,
      first_value(CASE WHEN st IS NOT NULL THEN round(value, 2) END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head_prev FROM s)
SELECT trip, ord, coalesce(filled, CASE WHEN head = 'view' THEN 'before ' || CAST(head_prev AS VARCHAR) END) AS state FROM f""",
)
def prefix_backfill(spark, sf):
    """Rows before the first known state take that row's previous state if it is 'view'."""
    f = D.ordered_frames(spark, sf, "label", "value")
    state = F.when(F.col("label").isin("click", "view", "purchase"), F.col("label"))
    prev = F.concat(F.lit("before "), F.round("value", 2).cast("string"))
    out = TR.fill_states(f.withColumn("s", state).withColumn("p", prev), K, "s", "p", trigger="view", out="state")
    return out.select("trip", "ord", "state")


@query(
    "rolling_trend",
    f"""WITH {D.FRAMES_SQL},
d AS (SELECT *, value - lag(value) OVER w AS step FROM frames {W}),
r AS (SELECT *, sum(step) OVER r AS s, count(step) OVER r AS n FROM d
      WINDOW r AS (PARTITION BY trip ORDER BY t, ord ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT trip, ord, CASE WHEN n = 15 THEN round(s, 4) END AS trend FROM r""",
)
def rolling_trend(spark, sf):
    """15-row rolling sum of differences, null until 15 differences exist."""
    f = D.ordered_frames(spark, sf, "value")
    return TR.rolling_difference(f, K, "value", rows=15, out="trend").select(
        "trip", "ord", F.round("trend", 4).alias("trend")
    )


@query(
    "trend_start",
    f"""WITH {D.FRAMES_SQL},
d AS (SELECT *, value - lag(value) OVER w AS step FROM frames {W}),
r AS (SELECT *, sum(step) OVER r AS s, count(step) OVER r AS n FROM d
      WINDOW r AS (PARTITION BY trip ORDER BY t, ord ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT trip, min(t) AS started FROM r WHERE n = 15 AND s <= -0.000001 GROUP BY trip""",
)
def trend_start(spark, sf):
    """First time the rolling sum falls below the threshold."""
    f = D.ordered_frames(spark, sf, "value")
    return TR.first_decline(f, K, "t", "value", rows=15, threshold=-0.000001, out="started")


@query(
    "lead_drop",
    f"""WITH {D.FRAMES_SQL}
SELECT trip, ord, round(value - lead(value, 5) OVER w, 6) AS drop5 FROM frames {W}""",
)
def lead_drop(spark, sf):
    f = D.ordered_frames(spark, sf, "value")
    out = S.neighbours(f, K, 0, 5, lambda w: {"drop5": F.round(F.col("value") - F.lead("value", 5).over(w), 6)})
    return out.select("trip", "ord", "drop5")


@query(
    "cumulative_distance",
    f"""WITH {D.FRAMES_SQL},
d AS (SELECT *, value * coalesce(t - lag(t) OVER w, 0) AS part FROM frames {W})
SELECT trip, ord, round(sum(part) OVER (PARTITION BY trip ORDER BY t, ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1000, 3) AS distance FROM d""",
)
def cumulative_distance(spark, sf):
    """Speed times elapsed time, summed from the first row on."""
    f = D.ordered_frames(spark, sf, "value")
    out = TR.cumulative_distance(f, K, "t", "value", out="d")
    return out.select("trip", "ord", F.round(F.col("d") / 1000, 3).alias("distance"))


@query(
    "sustained_stop",
    f"""WITH {D.FRAMES_SQL},
g AS (SELECT trip, median(dt) AS m FROM (SELECT trip, t - lag(t) OVER w AS dt FROM frames {W}) WHERE dt IS NOT NULL GROUP BY trip),
n AS (SELECT trip, greatest(1, CAST(round_even(20000.0 / CASE WHEN m > 0 THEN m ELSE 0.1 END, 0) AS BIGINT)) AS need FROM g),
s AS (SELECT f.*, value <= 20 AS slow,
      row_number() OVER w AS rn FROM frames f {W}),
i AS (SELECT *, rn - row_number() OVER (PARTITION BY trip, slow ORDER BY t, ord) AS isl FROM s),
r AS (SELECT trip, isl, min(t) AS b, count(*) AS len FROM i WHERE slow GROUP BY trip, isl)
SELECT r.trip, min(b) AS stopped FROM r JOIN n USING (trip) WHERE len >= need GROUP BY r.trip""",
)
def sustained_stop(spark, sf):
    """Start of the first run of slow rows as long as the trip's own sampling rate asks for."""
    f = D.ordered_frames(spark, sf, "value")
    return TR.sustained_stop(f, K, "t", "value", threshold=20.0, min_duration=20000.0, out="stopped")


@query(
    "critical_point_latch",
    f"""WITH {D.FRAMES_SQL},
s AS (SELECT *, CASE WHEN k > 10 THEN sign(value - 20) END AS sg FROM frames),
b AS (SELECT *, first_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM s),
c AS (SELECT *, max(CASE WHEN sg = -base THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM b)
SELECT trip, ord, CASE WHEN sg IS NOT NULL AND gone = 0 THEN round(abs(value - 20) / k, 6) END AS critical FROM c""",
)
def critical_point_latch(spark, sf):
    """Distance over speed until the signed distance changes side; slow rows neither set nor trip the latch."""
    f = D.ordered_frames(spark, sf, "value", "k")
    out = TR.sign_latch(f, K, F.col("value") - 20, valid=F.col("k") > 10, out="open")
    return out.select(
        "trip", "ord", F.when(F.col("open"), F.round(F.abs(F.col("value") - 20) / F.col("k"), 6)).alias("critical")
    )


@query(
    "truncate_after_first",
    f"""WITH {D.FRAMES_SQL},
h AS (SELECT *, coalesce(sum(CAST(label = 'purchase' AS INTEGER)) OVER (PARTITION BY trip ORDER BY t, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM frames)
SELECT trip, ord, label FROM h WHERE hits = 0""",
)
def truncate_after_first(spark, sf):
    """Rows up to and including the first purchase."""
    f = D.ordered_frames(spark, sf, "label")
    return TR.truncate_after_first(f, K, F.col("label") == "purchase").select("trip", "ord", "label")


@query(
    "relative_time",
    f"""WITH {D.FRAMES_SQL}
SELECT trip, ord, round(t - min(t) OVER (PARTITION BY trip), 6) AS from_start,
       round(t - min(t) OVER (PARTITION BY trip, label), 6) AS from_label FROM frames""",
)
def relative_time(spark, sf):
    """Time since the start of the trip and since the first row of the same label."""
    f = D.frames(spark, sf).select("trip", "t", "ord", "label")
    out = TR.relative_time(TR.relative_time(f, K, "t", "from_start"), ["trip", "label"], "t", "from_label")
    return out.select("trip", "ord", F.round("from_start", 6).alias("from_start"), F.round("from_label", 6).alias("from_label"))


@query(
    "monotone_violations",
    f"""WITH {D.FRAMES_SQL},
d AS (SELECT trip, value - lag(value) OVER w AS step FROM frames {W})
SELECT trip, CAST(count(*) FILTER (step < -0.01) AS BIGINT) AS violations FROM d GROUP BY trip""",
)
def monotone_violations(spark, sf):
    f = D.ordered_frames(spark, sf, "value")
    return TR.monotone_violations(f, K, "value", tolerance=-0.01)


@query(
    "first_in_group",
    f"""WITH {D.FRAMES_SQL},
q AS (SELECT *, k < 30 AND value > 10 AS hit FROM frames),
r AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY trip, label) AS any_hit,
      min(CASE WHEN hit THEN ord END) OVER (PARTITION BY trip, label) AS first_ord FROM q)
SELECT trip, ord, CASE WHEN any_hit = 1 THEN CAST(ord = first_ord AS INTEGER) END AS flag FROM r""",
)
def first_in_group(spark, sf):
    """1 on the first qualifying row of a group, 0 on its other rows, null in groups without one."""
    f = D.ordered_frames(spark, sf, "label", "value", "k")
    hit = (F.col("k") < 30) & (F.col("value") > 10)
    return TR.first_flag(f, ["trip", "label"], hit, out="flag").select("trip", "ord", "flag")


# --- joins -----------------------------------------------------------------------------------

_TRACKS = "tracks AS (SELECT trip, t AS tt, ord AS tord, label AS tname, value AS tvalue FROM frames WHERE label IN ('view','click')), probes AS (SELECT trip, t, ord FROM frames WHERE label NOT IN ('view','click'))"


def _asof(spark, sf, direction):
    f = D.frames(spark, sf)
    tracks = f.where(F.col("label").isin("view", "click"))
    probes = f.where(~F.col("label").isin("view", "click")).select("trip", "t", "ord")
    out = J.asof_join(probes, tracks.withColumnRenamed("ord", "tord"), K, "t", ["tord", "value"], right_order="tord", direction=direction)
    return out.select("trip", "ord", "tord", F.round("value", 6).alias("value"))


@query(
    "asof_nearest",
    f"""WITH {D.FRAMES_SQL}, {_TRACKS},
b AS (SELECT p.*, q.tt AS bt, q.tord AS bo, q.tvalue AS bv FROM probes p ASOF LEFT JOIN tracks q ON p.trip = q.trip AND p.t >= q.tt),
n AS (SELECT b.*, q.tt AS ft, q.tord AS fo, q.tvalue AS fv FROM b ASOF LEFT JOIN tracks q ON b.trip = q.trip AND b.t <= q.tt)
SELECT trip, ord, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bo ELSE fo END AS tord,
       round(CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bv ELSE fv END, 6) AS value FROM n""",
)
def asof_nearest(spark, sf):
    """Nearest track sample of the same trip for every other row; ties go back in time."""
    return _asof(spark, sf, "nearest")


@query(
    "asof_backward",
    f"""WITH {D.FRAMES_SQL}, {_TRACKS}
SELECT p.trip, p.ord, q.tord, round(q.tvalue, 6) AS value
FROM probes p ASOF LEFT JOIN tracks q ON p.trip = q.trip AND p.t >= q.tt""",
)
def asof_backward(spark, sf):
    return _asof(spark, sf, "backward")


@query(
    "nearest_frame_flag",
    f"""WITH {D.FRAMES_SQL},
targets AS (SELECT DISTINCT o_custkey AS trip, epoch(o_orderdate - TIMESTAMP '1996-01-01') / 86400.0 * 900 AS x FROM orders),
b AS (SELECT g.*, q.t AS bt, q.ord AS bo FROM targets g ASOF LEFT JOIN frames q ON g.trip = q.trip AND g.x >= q.t),
n AS (SELECT b.*, q.t AS ft, q.ord AS fo FROM b ASOF LEFT JOIN frames q ON b.trip = q.trip AND b.x <= q.t),
m AS (SELECT DISTINCT trip, CASE WHEN ft IS NULL OR x - bt <= ft - x THEN bo ELSE fo END AS ord FROM n WHERE bt IS NOT NULL OR ft IS NOT NULL)
SELECT f.trip, f.ord, CAST(m.ord IS NOT NULL AS INTEGER) AS flag FROM frames f LEFT JOIN m ON f.trip = m.trip AND f.ord = m.ord""",
)
def nearest_frame_flag(spark, sf):
    """Orders as marks on the time line of the user with the same number: flag the closest frame."""
    f = D.ordered_frames(spark, sf)
    marks = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("trip"), (D.days("o_orderdate", "1996-01-01") * 900).alias("x")
    )
    return TR.flag_nearest(f, marks, K, "t", "x", out="flag").select("trip", "ord", "flag")


@query(
    "interval_flags",
    f"""WITH {D.FRAMES_SQL}, {D.SPANS_SQL}
SELECT f.trip, f.ord, CAST(EXISTS (SELECT 1 FROM spans s WHERE s.trip = f.trip AND f.t >= s.a AND f.t <= s.b) AS INTEGER) AS broken
FROM frames f""",
)
def interval_flags(spark, sf):
    """Is the row inside some closed error-to-purchase span?"""
    f = D.ordered_frames(spark, sf, "label")
    spans = D.error_spans(f).withColumn("label", F.lit("broken")).withColumnRenamed("a", "start").withColumnRenamed("b", "end")
    flagged = E.flag_intervals(f.drop("label"), spans, ["broken"], keys=K, row_id=[S.SEQ], at="t", start="start", end="end")
    return flagged.select("trip", "ord", "broken")


@query(
    "interval_fill",
    f"""WITH {D.FRAMES_SQL}, {D.SPANS_SQL}
SELECT f.trip, f.ord, coalesce('broken ' || CAST(max(s.rank) AS VARCHAR), f.label) AS label
FROM frames f LEFT JOIN spans s ON s.trip = f.trip AND f.t > s.a AND f.t < s.b
GROUP BY f.trip, f.ord, f.label""",
)
def interval_fill(spark, sf):
    """Strictly inside a span the row takes the span's label; the later span wins."""
    f = D.ordered_frames(spark, sf, "label")
    spans = D.error_spans(f).select(
        "trip", F.col("a").alias("_from"), F.col("b").alias("_to"),
        F.concat(F.lit("broken "), F.col("rank").cast("string")).alias("_pair"), F.col("rank").alias("_rank"),
    )
    return E.fill_between(f, spans, keys=K, at="t", label="label").select("trip", "ord", "label")


@query(
    "order_spans",
    """WITH spans AS (SELECT o_orderkey, epoch(o_orderdate) / 86400.0 AS a, epoch(max(l_shipdate)) / 86400.0 AS b
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(count(s.o_orderkey) AS BIGINT) AS open_spans
FROM lineitem l LEFT JOIN spans s ON l.l_orderkey = s.o_orderkey
 AND epoch(l_shipdate) / 86400.0 >= s.a AND epoch(l_shipdate) / 86400.0 <= s.b
GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
)
def order_spans(spark, sf):
    """Ship dates inside [order date, last ship date] of their order, at line-item scale."""
    li = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", D.days("l_shipdate").alias("t")
    )
    orders = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), D.days("o_orderdate").alias("a"))
    spans = orders.join(li.groupBy("key").agg(F.max("t").alias("b")), "key").withColumn("hit", F.lit(1))
    row = [F.col("key").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"]
    pairs = J.interval_join(li, spans, ["key"], "t", "a", "b").select(*row, "hit")
    none = li.select(*row, F.lit(0).alias("hit"))
    return pairs.unionByName(none).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.sum("hit").alias("open_spans"))


@query(
    "point_event_attach",
    f"""WITH {D.FRAMES_SQL},
o AS (SELECT o_custkey AS trip, CAST(round_even(epoch(o_orderdate - TIMESTAMP '1996-01-01') / 86400.0, 0) AS BIGINT) AS ds, o_orderpriority AS mark FROM orders)
SELECT f.trip, f.ord, round_even(f.t / 1000 , 1) AS tenth, coalesce(o.mark, 'None') AS mark
FROM frames f LEFT JOIN o ON o.trip = f.trip AND o.ds = CAST(round_even(f.t / 1000 * 10, 0) AS BIGINT)""",
)
def point_event_attach(spark, sf):
    """Point events joined on the rounded tenth; unmatched rows get 'None', duplicates copy the row."""
    f = D.frames(spark, sf).select("trip", (F.col("t") / 1000).alias("SimulationTime"), "ord")
    marks = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("trip"),
        (D.days("o_orderdate", "1996-01-01") / 10).alias("SimulationTime"),
        F.col("o_orderpriority").alias("mark"),
    )
    out = E.attach_point_events(f, marks, keys=K, label="mark", extra=())
    return out.select("trip", "ord", F.col("SimulationTime").alias("tenth"), "mark")


@query(
    "start_end_pairs",
    f"""WITH {D.FRAMES_SQL},
n AS (SELECT trip, t, ord, CASE label WHEN 'error' THEN 'Start repair' WHEN 'purchase' THEN 'End repair'
       WHEN 'view' THEN 'Visit' WHEN 'click' THEN 'End visit' ELSE 'None' END AS label FROM frames),
p AS (SELECT *, CASE WHEN label LIKE '%epair' THEN 'repair' ELSE 'visit' END AS base FROM n WHERE label <> 'None'),
g AS (SELECT trip, base, arg_min(t, (t, ord)) FILTER (label LIKE 'Start%') AS s, arg_min(t, (t, ord)) FILTER (label LIKE 'End%') AS e,
      arg_min(t, (t, ord)) FILTER (label NOT LIKE 'End%') AS n FROM p GROUP BY trip, base)
SELECT trip, base, coalesce(s, n) AS t_from, e AS t_to, s IS NULL AS fallback FROM g WHERE e IS NOT NULL AND coalesce(s, n) IS NOT NULL""",
)
def start_end_pairs(spark, sf):
    """First start and end of each base event; a plain entry row stands in for a missing start."""
    f = D.ordered_frames(spark, sf, "label")
    name = F.create_map(*[F.lit(x) for x in ("error", "Start repair", "purchase", "End repair", "view", "Visit", "click", "End visit")])
    g = f.withColumn("label", F.coalesce(name[F.col("label")], F.lit("None")))
    g = g.withColumn("base", T.clean_event(F.col("label")))
    out = E.event_pairs(g, keys=K, at="t", label="label", base="base")
    return out.select("trip", F.col("_pair").alias("base"), F.col("_from").alias("t_from"), F.col("_to").alias("t_to"), F.col("_rank.fallback").alias("fallback"))


@query(
    "tail_fill",
    f"""WITH {D.FRAMES_SQL},
n AS (SELECT *, CASE label WHEN 'purchase' THEN 'Termination' WHEN 'view' THEN 'Start look' ELSE 'None' END AS lab,
      CASE WHEN label = 'purchase' AND value > 20 THEN 'Collided-with wall' END AS reason FROM frames),
x AS (SELECT trip, min(t) AS stop FROM n WHERE lab = 'Termination' AND reason ILIKE '%collided-%' GROUP BY trip),
l AS (SELECT n.trip, stop, max(t) AS last FROM n JOIN x USING (trip) WHERE lab = 'Start look' AND t < stop GROUP BY n.trip, stop)
SELECT n.trip, n.ord, CASE WHEN n.t > l.last AND n.t < l.stop AND lab = 'None' THEN 'look' ELSE lab END AS lab
FROM n LEFT JOIN l USING (trip)""",
)
def tail_fill(spark, sf):
    """The last event before a collision reaches up to the termination row."""
    f = D.ordered_frames(spark, sf, "label", "value")
    lab = F.when(F.col("label") == "purchase", "Termination").when(F.col("label") == "view", "Start look").otherwise("None")
    why = F.when((F.col("label") == "purchase") & (F.col("value") > 20), "Collided-with wall")
    g = f.withColumn("lab", lab).withColumn("base", lab).withColumn("reason", why)
    return E.fill_collision_tail(g, keys=K, label="lab", base="base", reason="reason").select("trip", "ord", "lab")


@query(
    "synth_starts",
    f"""WITH ev AS (
  SELECT o_custkey AS id, o_orderpriority AS cond, epoch(o_orderdate) / 86400.0 AS t,
    CASE o_orderstatus WHEN 'O' THEN 'StartPoint' WHEN 'F' THEN 'Start traffic light 1' ELSE 'End traffic light 1' END AS ev FROM orders),
org AS (SELECT id, cond, min(t) AS o FROM ev WHERE ev = 'StartPoint' GROUP BY id, cond),
del AS (SELECT e.cond, e.t - o AS d FROM ev e JOIN org USING (id, cond) WHERE ev LIKE 'Start traffic%'),
bnd AS (SELECT cond, avg(d) + 3 * stddev_samp(d) AS b FROM del GROUP BY cond),
med AS (SELECT cond, median(d) AS m FROM del JOIN bnd USING (cond) WHERE d <= b GROUP BY cond),
lack AS (SELECT id, cond FROM ev WHERE ev LIKE '%traffic%' GROUP BY id, cond HAVING NOT bool_or(ev LIKE 'Start traffic%'))
SELECT id, cond, round(o + m, 6) AS t, 'Start traffic light 1' AS ev FROM lack JOIN org USING (id, cond) JOIN med USING (cond)""",
)
def synth_starts(spark, sf):
    """Missing light starts at the start point plus the median delay of the other trips."""
    ev = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("cond"), D.days("o_orderdate").alias("t"),
        F.when(F.col("o_orderstatus") == "O", "StartPoint").when(F.col("o_orderstatus") == "F", "Start traffic light 1")
        .otherwise("End traffic light 1").alias("ev"), F.lit(False).alias("made"),
    )
    out = E.synthesize_missing_starts(ev, trip="id", group=["cond"], at="t", label="ev")
    return out.where("made is null").select("id", "cond", F.round("t", 6).alias("t"), "ev")


@query(
    "world_time",
    """WITH e AS (SELECT user_id AS trip, event_id AS ord, event_type, ts, epoch_us(ts) - 1704067200000000 AS us FROM events),
f AS (SELECT trip, min_by(ts, (ts, ord)) AS t0 FROM e GROUP BY trip)
SELECT e.trip, ord, CASE e.trip % 3 WHEN 0 THEN round(us / 1e6, 6)
   WHEN 1 THEN round((us % 86400000000) / 1e6, 6) ELSE round(epoch_us(ts) / 1e6 - epoch_us(t0) / 1e6, 3) END AS world
FROM e JOIN f USING (trip)""",
)
def world_time(spark, sf):
    """World time written as number, clock or date-time, read with one rule per trip."""
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("trip"), F.col("event_id").alias("ord"), "ts")
    third = F.col("trip") % 3
    shown = (
        F.when(third == 0, D.seconds("ts").cast("string"))
        .when(third == 1, F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    seq = S.sequence(e.withColumn("text", shown), K, ["ts", "ord"])
    out = E.world_seconds(seq, keys=K, text="text", out="world")
    return out.select(
        "trip", "ord", F.when(third == 2, F.round("world", 3)).otherwise(F.round("world", 6)).alias("world")
    )
