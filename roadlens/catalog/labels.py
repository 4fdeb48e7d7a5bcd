"""Label, text and number rules on the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.sources import logs
from roadlens.sources import shipped as D

# part names dressed up as event labels, the same way in Spark and SQL
_LABEL_SQL = """names AS (SELECT p_partkey, CASE p_type
  WHEN 'ECONOMY' THEN 'Start Traffic Light ' || p_size WHEN 'STANDARD' THEN 'End section-walker' || p_size || '!'
  WHEN 'PROMO' THEN '  Egocar Start gap  acceptance ' WHEN 'SMALL' THEN 'StartPoint'
  WHEN 'LARGE' THEN 'Walker ' || p_size WHEN 'MEDIUM' THEN 'end overtake ' || p_name ELSE p_name END AS label FROM part)"""


def _labels(spark, sf):
    p = D.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    kind = F.col("p_type")
    label = (
        F.when(kind == "ECONOMY", F.concat(F.lit("Start Traffic Light "), size))
        .when(kind == "STANDARD", F.concat(F.lit("End section-walker"), size, F.lit("!")))
        .when(kind == "PROMO", F.lit("  Egocar Start gap  acceptance "))
        .when(kind == "SMALL", F.lit("StartPoint"))
        .when(kind == "LARGE", F.concat(F.lit("Walker "), size))
        .when(kind == "MEDIUM", F.concat(F.lit("end overtake "), F.col("p_name")))
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", label.alias("label"))


@query(
    "type_normalize",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN ' G PS ' WHEN 'click' THEN 'car_Telemetry' WHEN 'purchase' THEN 'Telemetries'
  WHEN 'error' THEN 'TERMINATION' ELSE event_type END AS raw FROM events)
SELECT event_id, CASE replace(replace(lower(trim(raw)), ' ', ''), '_', '') WHEN 'gps' THEN 'GPS' WHEN 'cartelemetries' THEN 'Car_Telemetries'
  WHEN 'cartelemetry' THEN 'Car_Telemetries' WHEN 'telemetries' THEN 'Car_Telemetries' WHEN 'termination' THEN 'Termination' ELSE raw END AS kind FROM r""",
)
def type_normalize(spark, sf):
    """Record types in several spellings."""
    e = D.table(spark, sf, "events")
    kind = F.col("event_type")
    raw = F.when(kind == "view", " G PS ").when(kind == "click", "car_Telemetry").when(kind == "purchase", "Telemetries").when(kind == "error", "TERMINATION").otherwise(kind)
    return e.select("event_id", T.normalize_type(raw).alias("kind"))


@query(
    "clean_event",
    f"""WITH {_LABEL_SQL}
SELECT p_partkey, CASE WHEN label IN ('StartPoint', 'Start', 'None', 'Termination', 'EndPoint') THEN label ELSE
  trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '\\b(start|end)\\b', '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) END AS base,
  trim(regexp_replace(trim(label), '(?i)^(start|end)\\s+', '')) AS plain,
  lower(trim(regexp_replace(trim(label), '(?i)^(egocar\\s+)?(start|end)\\s+', ''))) AS core,
  regexp_replace(trim(regexp_replace(label, '(?i)\\b(start|end|egocar)\\b', '', 'g')), '\\s\\s+', ' ', 'g') AS needle FROM names""",
)
def clean_event(spark, sf):
    """The four cleaned forms of an event label."""
    c = F.col("label")
    return _labels(spark, sf).select(
        "p_partkey", T.clean_event(c).alias("base"), T.strip_leading_start_end(c).alias("plain"),
        T.feedback_event(c).alias("core"), T.match_label(c).alias("needle"),
    )


@query(
    "categorize",
    f"""WITH {_LABEL_SQL}, l AS (SELECT p_partkey, lower(trim(label)) AS s FROM names)
SELECT p_partkey, CASE WHEN regexp_matches(s, '\\b(startpoint|endpoint)\\b') THEN 'SimulationPoints'
  WHEN regexp_matches(s, '\\bwalker\\s*\\d*\\b') THEN 'Pedestrians' WHEN regexp_matches(s, '\\bovertake\\b') THEN 'Overtake'
  WHEN regexp_matches(s, '\\btraffic light\\s*\\d*\\b') THEN 'TrafficLights' WHEN regexp_matches(s, '\\bgap acceptance\\b') THEN 'GapAcceptance' END AS category FROM l""",
)
def categorize(spark, sf):
    return _labels(spark, sf).select("p_partkey", T.categorize(F.col("label")).alias("category"))


@query(
    "light_events",
    f"""WITH {_LABEL_SQL}
SELECT p_partkey, CAST(nullif(regexp_extract(lower(label), '(start|end)?\\s*traffic\\s*light\\s*(\\d+)', 2), '') AS BIGINT) AS light,
  CASE WHEN regexp_matches(lower(label), 'traffic\\s*light\\s*\\d+') THEN
    coalesce(nullif(regexp_extract(lower(label), '(start|end)?\\s*traffic\\s*light\\s*(\\d+)', 1), ''), 'entry') END AS kind,
  CASE WHEN lower(label) LIKE '%traffic light%' THEN lower('C1__Avatar__' || trim(regexp_replace(trim(label), '(?i)^(start|end)\\s+', ''))) END AS event_key,
  CASE WHEN regexp_matches(trim(label), '(?i)^(walker|pedestrian)\\s*(\\d+)$') THEN 'section walker' || regexp_extract(trim(label), '(\\d+)$', 1) ELSE label END AS walker
FROM names""",
)
def light_events(spark, sf):
    """Parsed light number and kind, event key, walker name."""
    c = F.col("label")
    return _labels(spark, sf).select(
        "p_partkey", T.light_number(c).alias("light"), T.light_event_kind(c).alias("kind"),
        T.event_key(F.lit("C1"), F.lit("Avatar"), c).alias("event_key"), T.normalize_walker(c).alias("walker"),
    )


@query(
    "comment_flag",
    """SELECT conv_id, turn, CAST(text IS NOT NULL AND regexp_replace(text, '\\s', '', 'g') <> '' AS INTEGER) AS comment_flag,
  role = 'user' OR role IS NULL AS from_user FROM conversations""",
)
def comment_flag(spark, sf):
    c = D.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.comment_flag(F.col("text")).alias("comment_flag"), F.coalesce(F.col("role") == "user", F.lit(True)).alias("from_user"))


@query(
    "vector_magnitude",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 8) AS magnitude FROM lineitem""",
)
def vector_magnitude(spark, sf):
    """Magnitude of a vector given as JSON text."""
    li = D.table(spark, sf, "lineitem")
    body = F.to_json(F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(logs.magnitude(body), 8).alias("magnitude"))


@query(
    "numeric_coercion",
    """WITH w AS (SELECT doc_id, TRY_CAST(unnest(string_split(text, ' ')) AS DOUBLE) AS x FROM documents),
n AS (SELECT doc_id, count(*) AS words, count(x) AS numbers, min(x) AS least, max(x) AS largest FROM (SELECT doc_id, CASE WHEN isfinite(x) THEN x END AS x FROM w) GROUP BY doc_id)
SELECT doc_id, words, numbers, least, largest, TRY_CAST(lang AS DOUBLE) AS lang_number, CAST(n_chars AS DOUBLE) AS chars FROM documents LEFT JOIN n USING (doc_id)""",
)
def numeric_coercion(spark, sf):
    """Every word of a text read as a number; anything else becomes null."""
    d = D.table(spark, sf, "documents")
    words = d.select("doc_id", F.explode(F.split("text", " ")).alias("word")).select("doc_id", N.number(F.col("word")).alias("x"))
    numbers = words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.count("x").alias("numbers"), F.min("x").alias("least"), F.max("x").alias("largest")
    )
    whole = d.select("doc_id", N.number(F.col("lang")).alias("lang_number"), N.number(F.col("n_chars").cast("string")).alias("chars"))
    return whole.join(numbers, "doc_id", "left")


@query(
    "frame_pairing",
    """WITH g AS (SELECT o_custkey AS trip, o_orderkey * 4 AS fid, o_totalprice AS price FROM orders),
t AS (SELECT o_custkey AS trip, o_orderkey * 4 + CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 2 * 1000000000 END AS fid,
      o_orderpriority AS prio FROM orders)
SELECT g.trip, g.fid AS FrameID, price, prio FROM g JOIN t ON g.trip = t.trip AND
  t.fid = g.fid + CASE g.trip % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 END""",
)
def frame_pairing(spark, sf):
    """Two record streams paired on equal, next or previous numbers, decided per trip."""
    o = D.table(spark, sf, "orders")
    fid = F.col("o_orderkey") * 4
    kind = F.col("o_custkey") % 4
    away = F.when(kind == 0, 0).when(kind == 1, 1).when(kind == 2, -1).otherwise(2 * 10**9)
    gps = o.select(F.col("o_custkey").alias("trip"), fid.alias("FrameID"), F.col("o_totalprice").alias("price"))
    tele = o.select(F.col("o_custkey").alias("trip"), (fid + away).alias("FrameID"), F.col("o_orderpriority").alias("prio"))
    return logs.pair_frames(gps, tele, ["trip"])
