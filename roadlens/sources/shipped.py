"""Views of the shipped parquet tables in the shape of drive logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.operators import scan as S

ORIGIN = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str | Column, origin: str = ORIGIN) -> Column:
    """Seconds since ``origin`` with microseconds."""
    c = F.col(ts) if isinstance(ts, str) else ts
    zero = F.lit(origin).cast("timestamp_ntz").cast("timestamp")
    return (F.unix_micros(c.cast("timestamp")) - F.unix_micros(zero)) / F.lit(1e6)


def days(ts: str | Column, origin: str = "1970-01-01") -> Column:
    return seconds(ts, origin) / F.lit(86400.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: trip = user, t = seconds, ord = event id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("trip"),
        seconds("ts").alias("t"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("label"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


# the same view for the SQL twins
FRAMES_SQL = """frames AS (
  SELECT user_id AS trip, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_id AS ord,
         event_type AS label, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""


def ordered_frames(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Frames numbered in (trip, t, ord) order."""
    f = frames(spark, sf_dir)
    if columns:
        f = f.select("trip", "t", "ord", *columns)
    return S.sequence(f, ["trip"], ["t", "ord"])


def error_spans(ordered: DataFrame) -> DataFrame:
    """Per trip: every error up to the next purchase (null if none follows)."""
    t = F.col("t")
    nxt = S.scan(ordered, ["trip"], until=S.next_known(F.when(F.col("label") == "purchase", t), inclusive=False))
    return nxt.where("label = 'error'").select("trip", t.alias("a"), F.col("until").alias("b"), F.col("ord").alias("rank"))


SPANS_SQL = """spans AS (
  SELECT trip, t AS a, until AS b, ord AS rank FROM (
    SELECT *, min(CASE WHEN label = 'purchase' THEN t END) OVER (
      PARTITION BY trip ORDER BY t, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until
    FROM frames) WHERE label = 'error')"""


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ego/object states on a small plane (fixed formulas)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_quantity") * 2).alias("x"),
        (F.col("l_discount") * 500).alias("y"),
        (F.col("l_extendedprice") / 1000).alias("speed"),
        (F.col("l_tax") * 4500).alias("yaw"),
        (F.col("l_suppkey") % 100).cast("double").alias("ox"),
        (F.col("l_partkey") % 60).cast("double").alias("oy"),
        (F.col("l_linenumber") - 4.0).alias("ovx"),
        (F.col("l_quantity") / 10 - 2.5).alias("ovy"),
    )


MOTION_SQL = """motion AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_quantity * 2 AS x, l_discount * 500 AS y, l_extendedprice / 1000 AS speed, l_tax * 4500 AS yaw,
         CAST(l_suppkey % 100 AS DOUBLE) AS ox, CAST(l_partkey % 60 AS DOUBLE) AS oy,
         CAST(l_linenumber AS DOUBLE) - 4.0 AS ovx, l_quantity / 10 - 2.5 AS ovy
  FROM lineitem)"""


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: y = toxic, q = quality, score = length in characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        "doc_id", "lang", "source", F.col("toxic").alias("y"), F.col("quality").alias("q"),
        F.col("n_chars").cast("double").alias("score"),
    )


OUTCOME_SQL = """outcome AS (
  SELECT doc_id, lang, source, toxic AS y, quality AS q, CAST(n_chars AS DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id))"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: hours from the first event to the first later purchase, else to the last event."""
    f = frames(spark, sf_dir)
    start = f.groupBy("trip").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("value").alias("level"))
    bought = f.where("label = 'purchase'").join(start.select("trip", "t0"), "trip").where("t > t0")
    first = bought.groupBy("trip").agg(F.min("t").alias("tp"))
    joined = start.join(first, "trip", "left")
    return joined.select(
        "trip",
        F.floor((F.coalesce("tp", "t1") - F.col("t0")) / 3600).cast("double").alias("duration"),
        F.col("tp").isNotNull().cast("int").alias("event"),
        (F.col("level") >= 20.0).cast("int").alias("grp"),
        "level",
    )


SURVIVAL_SQL = """base AS (
  SELECT trip, min(t) AS t0, max(t) AS t1, avg(value) AS level FROM frames GROUP BY trip),
bought AS (
  SELECT f.trip, min(f.t) AS tp FROM frames f JOIN base b USING (trip)
  WHERE f.label = 'purchase' AND f.t > b.t0 GROUP BY f.trip),
surv AS (
  SELECT trip, floor((coalesce(tp, t1) - t0) / 3600) AS duration,
         CAST(tp IS NOT NULL AS INTEGER) AS event, CAST(level >= 20.0 AS INTEGER) AS grp, level
  FROM base LEFT JOIN bought USING (trip))"""
