"""Events as drive frames of one long event per user, for the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.operators import scan as S
from roadlens.operators import windows as W
from roadlens.session import materialize
from roadlens.sources import shipped as D

SIZE = 24.0  # hours


def drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.frames(spark, sf_dir)
    lab, k, v = F.col("label"), F.col("k"), F.col("value")
    return f.select(
        F.col("trip").alias("event_id"),
        "ord",
        (F.col("t") / 3600).alias("t"),
        F.col("trip").alias("Id"),
        F.lit("Avatar").alias("Condition"),
        F.lit("A").alias("Map"),
        F.lit("TrafficLights").alias("event_category"),
        v.alias("Speed"),
        (k - 50).alias("Acceleration"),
        (v - k).alias("SteeringAngle"),
        F.when(lab == "error", v).otherwise(F.lit(0.0)).alias("Brake"),
        F.when(lab != "signup", k).alias("distance_from_relevant_object"),
        F.when(lab != "error", lab).alias("relevant_object_name"),
        F.when(k > 20, v / (k + 0.37) * 10).alias("time_to_collision"),
        F.when(lab == "click", "Green").when(lab == "view", "Yellow").when(lab == "purchase", "Red").alias("TrafficLight"),
        F.when(k < 30, "Approaching").when(k < 40, "AtStopLine").when(k < 70, "InsideJunction").when(k < 90, "LeavingJunction")
        .alias("TrafficLight_JunctionPhase"),
        ((lab == "purchase") & (v > 25)).alias("told"),
    )


DRIVE_SQL = f"""{D.FRAMES_SQL},
drive AS (SELECT trip AS event_id, ord, t / 3600 AS t, trip AS Id, 'Avatar' AS Condition, 'A' AS Map,
   'TrafficLights' AS event_category, value AS Speed, k - 50 AS Acceleration, value - k AS SteeringAngle,
   CASE WHEN label = 'error' THEN value ELSE 0.0 END AS Brake,
   CASE WHEN label <> 'signup' THEN k END AS distance_from_relevant_object,
   CASE WHEN label <> 'error' THEN label END AS relevant_object_name,
   CASE WHEN k > 20 THEN value / (k + 0.37) * 10 END AS time_to_collision,
   CASE label WHEN 'click' THEN 'Green' WHEN 'view' THEN 'Yellow' WHEN 'purchase' THEN 'Red' END AS TrafficLight,
   CASE WHEN k < 30 THEN 'Approaching' WHEN k < 40 THEN 'AtStopLine' WHEN k < 70 THEN 'InsideJunction'
        WHEN k < 90 THEN 'LeavingJunction' END AS phase,
   label = 'purchase' AND value > 25 AS told FROM frames),
span AS (SELECT event_id, min(t) AS t0, max(t) AS t1 FROM drive GROUP BY event_id),
placed AS (SELECT d.*, CAST(floor((d.t - t0) / 24) AS BIGINT) AS window_index, t0, t1 FROM drive d JOIN span USING (event_id)),
pw AS (SELECT *, t0 + window_index * 24.0 AS b FROM placed WHERE t0 + window_index * 24.0 < t1),
names AS (SELECT event_id, window_index, relevant_object_name,
   row_number() OVER (PARTITION BY event_id, window_index ORDER BY count(*) DESC, relevant_object_name) AS rn
   FROM pw WHERE relevant_object_name IS NOT NULL GROUP BY event_id, window_index, relevant_object_name),
feat AS (SELECT any_value(Id) AS Id, 'Avatar' AS Condition, 'A' AS Map, 'TrafficLights' AS event_category, event_id, window_index,
   CAST(b + 24 > t1 + 0.05 AS INTEGER) AS is_partial_window, round_even(b, 4) AS start_time,
   round_even(least(b + 24, t1), 4) AS end_time, 24.0::DOUBLE AS window_size_sec, max(t) AS max_time_since_event_start,
   min(distance_from_relevant_object) AS min_distance_from_relevant_object,
   CASE WHEN count(distance_from_relevant_object) >= 2 THEN
     round_even(arg_min(distance_from_relevant_object, (t, ord)) - arg_max(distance_from_relevant_object, (t, ord)), 4) END AS delta_distance,
   max(Brake) AS Brake_max, avg(CAST(coalesce(Brake > 0, false) AS INTEGER)) AS Braking_rate,
   max(Acceleration) AS Acceleration_max, min(Acceleration) AS Acceleration_min,
   avg(CAST(coalesce(Acceleration > 0, false) AS INTEGER)) AS Accelerating_rate,
   avg(Speed) AS Speed_mean, max(Speed) AS Speed_max, stddev_samp(Speed) AS Speed_std,
   round_even(last(Speed ORDER BY t, ord) - first(Speed ORDER BY t, ord), 4) AS Speed_delta,
   CAST(avg(Speed) < 0.5 AS INTEGER) AS is_stopped,
   max(abs(SteeringAngle)) AS SteeringAngle_absmax, stddev_samp(SteeringAngle) AS SteeringAngle_std,
   min(time_to_collision) AS TTC_min, avg(time_to_collision) AS TTC_mean,
   CASE WHEN count(time_to_collision) >= 2 THEN
     round_even(arg_max(time_to_collision, (t, ord)) - arg_min(time_to_collision, (t, ord)), 4) END AS TTC_delta,
   first(TrafficLight ORDER BY t, ord) AS TrafficLight_prev, last(TrafficLight ORDER BY t, ord) AS TrafficLight_current,
   CAST(coalesce(bool_or(TrafficLight = 'Yellow'), false)
        AND first(TrafficLight ORDER BY t, ord) IS DISTINCT FROM 'Yellow' AS INTEGER) AS yellow_transition,
   first(phase ORDER BY t, ord) AS prev_phase, last(phase ORDER BY t, ord) AS current_phase
   FROM pw GROUP BY event_id, window_index, b, t1),
feat2 AS (SELECT feat.*, relevant_object_name,
   CAST(prev_phase IS DISTINCT FROM current_phase OR prev_phase IS NULL AS INTEGER) AS transition_phase
   FROM feat LEFT JOIN (SELECT * FROM names WHERE rn = 1) USING (event_id, window_index)),
fb AS (SELECT event_id, min(t) AS f FROM drive WHERE told GROUP BY event_id),
timed AS (SELECT feat2.*, CAST(coalesce(start_time <= f AND f <= end_time, false) AS INTEGER) AS hit,
   CAST(coalesce(f > end_time AND f <= end_time + 24, false) AS INTEGER) AS soon FROM feat2 LEFT JOIN fb USING (event_id)),
cut AS (SELECT event_id, min(window_index) AS last_w FROM timed WHERE hit = 1 GROUP BY event_id),
win AS (SELECT timed.* FROM timed LEFT JOIN cut USING (event_id) WHERE last_w IS NULL OR window_index <= last_w)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the record number orders rows of one time, so no sequence is needed for a plain aggregate
    return W.window_features(drive(spark, sf_dir), size=SIZE, at="t", order="ord")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature windows with targets, written once for the operators that read them repeatedly."""
    feedback = drive(spark, sf_dir).where("told").select("event_id", F.col("t").alias("feedback_at"))
    out = W.window_targets(features(spark, sf_dir), feedback, horizon=SIZE, out="hit")
    return materialize(out.withColumnRenamed("feedback_next_1s", "soon"), "windows")
