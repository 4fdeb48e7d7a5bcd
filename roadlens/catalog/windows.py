"""Event windows on the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.operators import windows as W
from roadlens.session import materialize
from roadlens.sources import shipped as D
from roadlens.sources import shipped_windows as V

_ROUNDED = [
    "max_time_since_event_start", "min_distance_from_relevant_object", "Brake_max", "Braking_rate", "Acceleration_max",
    "Acceleration_min", "Accelerating_rate", "Speed_mean", "Speed_max", "Speed_std", "SteeringAngle_absmax",
    "SteeringAngle_std", "TTC_min", "TTC_mean",
]
_ROUND_SQL = ", ".join(f"round({c}, 8) AS {c}" for c in _ROUNDED)
_DELTAS = ["delta_distance", "Speed_delta", "TTC_delta"]


def _rounded(df, digits=8, columns=_ROUNDED):
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


@query(
    "tumble_windows",
    f"""WITH {V.DRIVE_SQL}
SELECT event_id, window_index, is_partial_window, start_time, end_time, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT event_id, window_index, CAST(b + 24 > t1 + 0.05 AS INTEGER) AS is_partial_window,
         round_even(b, 4) AS start_time, round_even(least(b + 24, t1), 4) AS end_time FROM pw)
GROUP BY ALL""",
)
def tumble_windows(spark, sf):
    """24-hour windows from each user's own first event."""
    placed = W.place_in_windows(V.drive(spark, sf).select("event_id", "t"), ["event_id"], "t", V.SIZE)
    return placed.groupBy("event_id", "window_index", "is_partial_window", "start_time", "end_time").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "window_features",
    f"""WITH {V.DRIVE_SQL}
SELECT * REPLACE ({_ROUND_SQL}) FROM feat2""",
)
def window_features(spark, sf):
    return _rounded(V.features(spark, sf))


@query(
    "window_target",
    f"""WITH {V.DRIVE_SQL} SELECT event_id, window_index, start_time, end_time, hit, soon FROM win""",
)
def window_target(spark, sf):
    """Feedback inside and shortly after a window; windows after the first hit are cut."""
    return V.windows(spark, sf).select("event_id", "window_index", "start_time", "end_time", "hit", "soon")


@query(
    "impute",
    f"""WITH {V.DRIVE_SQL},
kept AS (SELECT * FROM win WHERE relevant_object_name IS NOT NULL),
m AS (SELECT median(Acceleration_max) AS a, median(SteeringAngle_std) AS s, avg(min_distance_from_relevant_object) AS d FROM kept)
SELECT event_id, window_index,
  coalesce(prev_phase, CASE WHEN is_partial_window = 1 THEN 'Approaching' ELSE 'LeavingJunction' END) AS prev_phase,
  coalesce(TrafficLight_prev, 'Green') AS TrafficLight_prev, round(coalesce(Speed_std, 0), 8) AS Speed_std,
  round(coalesce(SteeringAngle_std, m.s), 8) AS SteeringAngle_std, round(coalesce(Acceleration_max, m.a), 8) AS Acceleration_max,
  round(coalesce(min_distance_from_relevant_object, m.d), 8) AS min_distance_from_relevant_object,
  round(coalesce(TTC_min, 999), 8) AS TTC_min FROM kept, m""",
)
def impute(spark, sf):
    """Fixed, median and mean fills; TTC filled with the large number."""
    out = _rounded(W.impute(V.windows(spark, sf), ttc_fill=W.TTC_FILL))
    return out.select(
        "event_id", "window_index", "prev_phase", "TrafficLight_prev", "Speed_std", "SteeringAngle_std", "Acceleration_max",
        "min_distance_from_relevant_object", "TTC_min",
    )


@query(
    "null_report",
    f"""WITH {V.DRIVE_SQL},
kept AS (SELECT * FROM win WHERE relevant_object_name IS NOT NULL)
SELECT * FROM (
  SELECT 'TTC_min' AS column_name, CAST(count(*) FILTER (TTC_min IS NULL) AS BIGINT) AS nulls_before,
     (SELECT CAST(count(*) FILTER (TTC_min IS NULL) AS BIGINT) FROM kept) AS nulls_after FROM win
  UNION ALL SELECT 'Speed_std', count(*) FILTER (Speed_std IS NULL), 0 FROM win
  UNION ALL SELECT 'relevant_object_name', count(*) FILTER (relevant_object_name IS NULL), 0 FROM win
  UNION ALL SELECT 'current_phase', count(*) FILTER (current_phase IS NULL), 0 FROM win)""",
)
def null_report(spark, sf):
    win = V.windows(spark, sf)
    report = W.null_report(win, W.impute(win))
    return report.where(F.col("column_name").isin("TTC_min", "Speed_std", "relevant_object_name", "current_phase"))


@query(
    "short_events",
    f"""WITH {V.DRIVE_SQL},
s AS (SELECT event_id, CAST(count(*) AS BIGINT) AS n_rows, max(soon) AS ends_with_feedback FROM win GROUP BY event_id)
SELECT *, (ends_with_feedback = 1 AND n_rows < 2) OR (ends_with_feedback = 0 AND n_rows < 3) AS too_short FROM s""",
)
def short_events(spark, sf):
    return W.short_events(V.windows(spark, sf), hit="soon")


@query(
    "n_row_windows",
    f"""WITH {V.DRIVE_SQL},
r AS (SELECT *, row_number() OVER w - 1 AS rn, max(soon) OVER (PARTITION BY event_id ORDER BY window_index
        ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead FROM win WINDOW w AS (PARTITION BY event_id ORDER BY window_index))
SELECT event_id, rn // 3 AS window_index, first(start_time ORDER BY rn) AS start_time, last(end_time ORDER BY rn) AS end_time,
  round(max(Brake_max), 8) AS Brake_max, round(avg(Speed_mean), 8) AS Speed_mean, round(min(TTC_min), 8) AS TTC_min,
  round(last(Speed_mean ORDER BY rn) - first(Speed_mean ORDER BY rn), 8) AS Speed_delta,
  last(current_phase ORDER BY rn) AS current_phase, coalesce(last(ahead ORDER BY rn), 0) AS feedback_next
FROM r GROUP BY event_id, rn // 3 HAVING count(*) = 3""",
)
def n_row_windows(spark, sf):
    """Three windows merged, feedback looked for in the next two."""
    out = W.n_row_windows(V.windows(spark, sf), n=3, horizon=2, target="soon")
    return _rounded(out, 8, [*_ROUNDED, *_DELTAS]).select(
        "event_id", "window_index", "start_time", "end_time", "Brake_max", "Speed_mean", "TTC_min", "Speed_delta",
        "current_phase", "feedback_next",
    )


_CELLS_SQL = f"""{V.DRIVE_SQL},
d AS (SELECT event_id, CAST(window_index AS DOUBLE) AS s, Speed_mean, least(coalesce(TTC_min, 999), 6) AS ttc, hit FROM win),
sp AS (SELECT event_id, min(s) AS s0, max(s) + 1 AS s1 FROM d GROUP BY event_id),
wr AS (SELECT d.*, s0, s1, w.w, CAST(floor((s - s0) / w.w) AS BIGINT) AS k FROM d JOIN sp USING (event_id), (VALUES (1),(2),(3),(4),(5)) w(w)),
cw AS (SELECT event_id, w, k, s0, min(ttc) AS TTC_min, avg(Speed_mean) AS Speed_mean FROM wr WHERE s0 + (k + 1) * w <= s1 GROUP BY event_id, w, k, s0),
cells AS (SELECT c.event_id, c.w AS win, h.h AS horizon, c.k AS window_no, TTC_min, Speed_mean,
  CAST(EXISTS (SELECT 1 FROM d WHERE d.event_id = c.event_id AND d.hit = 1 AND d.s >= c.s0 + (c.k + 1) * c.w
     AND d.s < c.s0 + (c.k + 1) * c.w + h.h) AS INTEGER) AS target FROM cw c, (VALUES (1),(2),(3),(4),(5)) h(h))"""


def cells(spark, sf):
    """Grid cells: sizes and horizons 1-5, in days."""
    d = V.windows(spark, sf).select(
        "event_id", F.col("window_index").cast("double").alias("s"), "Speed_mean",
        F.least(F.coalesce("TTC_min", F.lit(W.TTC_FILL)), F.lit(W.TTC_CEILING)).alias("ttc"), "hit",
    )
    return W.horizon_windows(
        materialize(d, "days"), sizes=[1, 2, 3, 4, 5], horizons=[1, 2, 3, 4, 5], at="s", hit="hit",
        features={"TTC_min": ("ttc", "min"), "Speed_mean": ("Speed_mean", "mean")},
    )


@query(
    "horizon_windows",
    f"""WITH {_CELLS_SQL}
SELECT event_id, win, horizon, window_no, round(TTC_min, 8) AS TTC_min, round(Speed_mean, 8) AS Speed_mean, target FROM cells""",
)
def horizon_windows(spark, sf):
    return cells(spark, sf).withColumns({c: F.round(c, 8) for c in ("TTC_min", "Speed_mean")})


@query(
    "grid_cells",
    f"""WITH {_CELLS_SQL}
SELECT win, horizon, CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS positives FROM cells GROUP BY win, horizon""",
)
def grid_cells(spark, sf):
    """Rows and positives of every window x horizon cell."""
    return cells(spark, sf).groupBy("win", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives")
    )


# one pass per rule branch, written as in the rule's text rather than as in the operator
_SEG_SQL = f"""{V.DRIVE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY start_time) AS i FROM feat2),
y AS (SELECT event_id, min(i) AS yp FROM r WHERE yellow_transition = 1 GROUP BY event_id),
fi AS (SELECT event_id, min(i) AS fi FROM r WHERE current_phase = 'InsideJunction' GROUP BY event_id),
el AS (SELECT r.event_id, TrafficLight_current AS entry FROM r JOIN fi ON r.event_id = fi.event_id AND r.i = fi.fi),
rd AS (SELECT r.event_id, max(i) AS red FROM r JOIN y USING (event_id) WHERE i >= yp AND TrafficLight_current = 'Red' GROUP BY r.event_id),
st AS (SELECT r.event_id, min(i) AS stop FROM r JOIN fi USING (event_id) WHERE i >= fi AND Speed_mean < 18
       AND current_phase IN ('InsideJunction', 'LeavingJunction') GROUP BY r.event_id),
j AS (SELECT r.*, yp, fi, entry, coalesce(red, yp) AS red, stop, coalesce(current_phase = 'Approaching', false) AS ap,
      coalesce(current_phase IN ('InsideJunction', 'LeavingJunction'), false) AS ju
      FROM r LEFT JOIN y USING (event_id) LEFT JOIN fi USING (event_id) LEFT JOIN el USING (event_id) LEFT JOIN rd USING (event_id) LEFT JOIN st USING (event_id)),
seg AS (SELECT *, CASE
   WHEN yp IS NULL THEN CASE WHEN ap THEN 1 WHEN ju THEN 3 END
   WHEN fi IS NULL THEN CASE WHEN ap AND i < yp THEN 1 WHEN ap THEN 2 END
   WHEN entry = 'Green' THEN CASE WHEN i > red AND (ap OR ju) THEN 3 WHEN i >= yp AND ap AND i <= red THEN 2 WHEN i < yp AND ap THEN 1 END
   WHEN stop IS NOT NULL THEN CASE WHEN i > stop AND (ap OR ju) THEN 3 WHEN i >= yp AND i <= stop AND (ap OR ju) THEN 2 WHEN i < yp AND ap THEN 1 END
   ELSE CASE WHEN i >= yp AND (ap OR ju) THEN 2 WHEN i < yp AND ap THEN 1 END END AS segment FROM j)"""


def segmented(spark, sf):
    slow = V.features(spark, sf).withColumn("is_stopped", (F.col("Speed_mean") < 18).cast("int"))
    return W.assign_segments(materialize(slow, "features"))


@query("segments", f"WITH {_SEG_SQL} SELECT event_id, window_index, segment FROM seg")
def segments(spark, sf):
    return segmented(spark, sf).select("event_id", "window_index", "segment")


@query(
    "segment_times",
    f"""WITH {_SEG_SQL}
SELECT event_id, window_index, round(CASE WHEN segment IN (1, 2) THEN least(coalesce(TTC_min, 999), 6) END, 8) AS TTC_imputed,
  round(start_time - min(start_time) OVER (PARTITION BY event_id), 4) AS time_from_event_start,
  round(CASE WHEN segment IS NOT NULL THEN start_time - min(start_time) OVER (PARTITION BY event_id, segment) END, 4) AS time_from_seg_start
FROM seg""",
)
def segment_times(spark, sf):
    out = W.segment_times(segmented(spark, sf))
    return out.select(
        "event_id", "window_index", F.round("TTC_imputed", 8).alias("TTC_imputed"),
        F.round("time_from_event_start", 4).alias("time_from_event_start"),
        F.round("time_from_seg_start", 4).alias("time_from_seg_start"),
    )


@query(
    "entry_light",
    f"""WITH {V.DRIVE_SQL},
f AS (SELECT event_id, arg_min(TrafficLight_current, start_time) AS light FROM feat2
      WHERE current_phase = 'InsideJunction' AND TrafficLight_current IS NOT NULL GROUP BY event_id)
SELECT e.event_id, CASE WHEN light = 'Green' THEN 'Green' ELSE 'Yellow/Red' END AS entry_light
FROM (SELECT DISTINCT event_id FROM feat2) e LEFT JOIN f USING (event_id)""",
)
def entry_light(spark, sf):
    return W.entry_light_split(V.features(spark, sf))


_EVENT_SQL = f"""{V.DRIVE_SQL},
ye AS (SELECT event_id, arg_min(TTC_min, start_time) AS ttc, min(start_time) AS ys FROM win WHERE yellow_transition = 1 GROUP BY event_id),
fe AS (SELECT event_id, min(start_time) AS ft, first(TrafficLight_current ORDER BY start_time) AS fl FROM win WHERE hit = 1 GROUP BY event_id),
ev AS (SELECT event_id, event_id AS Id, 'Avatar' AS Condition, 'A' AS Map, ttc AS TTC_min_at_yellow, ys AS yellow_start_time,
   CAST(ft IS NOT NULL AS INTEGER) AS hit, ft AS feedback_time, fl AS TrafficLight_at_feedback, ft - ys AS time_to_feedback
   FROM ye LEFT JOIN fe USING (event_id))"""


@query(
    "event_first_yellow",
    f"""WITH {_EVENT_SQL}
SELECT * REPLACE (round(TTC_min_at_yellow, 8) AS TTC_min_at_yellow, round(time_to_feedback, 3) AS time_to_feedback) FROM ev""",
)
def event_first_yellow(spark, sf):
    out = W.event_table(V.windows(spark, sf), hit="hit")
    return out.withColumns({"TTC_min_at_yellow": F.round("TTC_min_at_yellow", 8), "time_to_feedback": F.round("time_to_feedback", 3)})


@query(
    "iqr_outliers",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b,
  quantile_cont(l_extendedprice, 0.99) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(l_extendedprice, p), 4) AS capped,
  round(ln(l_extendedprice + 1), 6) AS logged, l_extendedprice > b + 0.5 * (b - a) AS is_outlier FROM lineitem, q""",
)
def iqr_outliers(spark, sf):
    """Outlier flag, cap at the 99th percentile and log, at line-item scale."""
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = W.flag_outliers(W.cap_at_quantile(li, "l_extendedprice", 0.99, "capped"), "l_extendedprice", factor=0.5)
    return out.withColumn("capped", F.round("capped", 4)).withColumn("logged", F.round(F.log1p("l_extendedprice"), 6)).drop("l_extendedprice")


@query(
    "survival_rows",
    f"""WITH {V.DRIVE_SQL},
f AS (SELECT event_id, min(window_index) AS fw FROM feat2 WHERE yellow_transition = 1 GROUP BY event_id)
SELECT event_id, window_index, coalesce(CAST(window_index = fw AS INTEGER), 0) AS event, round(CASE WHEN TTC_min IS NOT NULL THEN least(TTC_min, 20) END, 8) AS TTC_capped,
  round(ln(1 + CASE WHEN TTC_min IS NOT NULL THEN least(TTC_min, 20) END), 8) AS TTC_log FROM feat2 LEFT JOIN f USING (event_id) WHERE fw IS NULL OR window_index <= fw""",
)
def survival_rows(spark, sf):
    out = W.survival_rows(materialize(V.features(spark, sf), "features"), hit="yellow_transition")
    return out.select("event_id", "window_index", "event", F.round("TTC_capped", 8).alias("TTC_capped"), F.round("TTC_log", 8).alias("TTC_log"))


@query(
    "event_durations",
    f"""WITH {V.DRIVE_SQL},
g AS (SELECT event_id, coalesce(min(CASE WHEN hit = 1 THEN start_time END), max(start_time)) AS duration, max(hit) AS event, avg(TTC_min) AS level FROM win GROUP BY event_id)
SELECT event_id, duration, event, round(level, 8) AS level, coalesce(CAST(level >= (SELECT median(level) FROM g) AS INTEGER), 0) AS grp FROM g""",
)
def event_durations(spark, sf):
    out = W.event_durations(V.windows(spark, sf), at="start_time", hit="hit", level="TTC_min")
    return out.withColumn("level", F.round("level", 8))


@query(
    "one_hot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O,
  CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""",
)
def one_hot(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return W.one_hot(o, W.categories(o, ["o_orderstatus"]))


@query(
    "group_kfold",
    """WITH g AS (SELECT o_custkey, max(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS stratum FROM orders GROUP BY o_custkey),
n AS (SELECT stratum, count(*) AS n FROM g GROUP BY stratum)
SELECT stratum, f.f AS fold, CAST(n // 5 + CAST(f.f < n % 5 AS INTEGER) AS BIGINT) AS customers, CAST(1 AS BIGINT) AS folds_per_customer
FROM n, (VALUES (0),(1),(2),(3),(4)) f(f)""",
)
def group_kfold(spark, sf):
    """Stratified folds of whole customers: sizes per stratum, and that no customer is split."""
    o = D.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    folded = W.group_folds(o, group="o_custkey", label="y", k=5)
    per = folded.groupBy("o_custkey").agg(F.max("y").alias("stratum"), F.min("fold").alias("fold"), F.count_distinct("fold").alias("n"))
    return per.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("customers"), F.max("n").alias("folds_per_customer"))
