"""Quality reports and ragged text on the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.operators import quality as Q
from roadlens.operators import scan as S
from roadlens.sources import logs
from roadlens.sources import shipped as D
from roadlens.sources import sinks


@query(
    "quality_report",
    """WITH c(column_name, check_id, check_type, bad, n_rows_checked, n_rows_failed) AS (
  SELECT 'p_name', 'p_name.format', 'semantic', 'FAIL', count(p_name), count(*) FILTER (NOT regexp_matches(p_name, '^(small|red) [a-z]+$')) FROM part
  UNION ALL SELECT 'p_type', 'p_type.enum', 'semantic', 'WARN', count(p_type), count(*) FILTER (p_type NOT IN ('ECONOMY', 'PROMO')) FROM part
  UNION ALL SELECT 'p_size', 'p_size.range', 'semantic', 'FAIL', count(p_size), count(*) FILTER (p_size > 45 OR p_size < 0) FROM part
  UNION ALL SELECT 'p_brand', 'p_brand.hygiene', 'semantic', 'FAIL', count(p_brand), 0 FROM part
  UNION ALL SELECT 'p_size', 'p_size.binary', 'semantic', 'FAIL', count(*), count(*) FILTER (p_size NOT IN (0, 1)) FROM part
  UNION ALL SELECT 'p_brand', 'p_brand.only.cheap', 'cross-column', 'FAIL', count(p_brand), count(*) FILTER (p_retailprice >= 1000) FROM part),
e AS (SELECT 'p_name.format' AS check_id, p_partkey FROM part WHERE NOT regexp_matches(p_name, '^(small|red) [a-z]+$')
  UNION ALL SELECT 'p_type.enum', p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')
  UNION ALL SELECT 'p_size.range', p_partkey FROM part WHERE p_size > 45 OR p_size < 0
  UNION ALL SELECT 'p_size.binary', p_partkey FROM part WHERE p_size NOT IN (0, 1)
  UNION ALL SELECT 'p_brand.only.cheap', p_partkey FROM part WHERE p_retailprice >= 1000),
x AS (SELECT check_id, string_agg(CAST(p_partkey AS VARCHAR), ', ' ORDER BY p_partkey) AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY p_partkey) AS rn FROM e) WHERE rn <= 5 GROUP BY check_id)
SELECT column_name, c.check_id, check_type, CASE WHEN n_rows_failed = 0 THEN 'PASS' ELSE bad END AS status, CAST(n_rows_checked AS BIGINT) AS n_rows_checked,
  CAST(n_rows_failed AS BIGINT) AS n_rows_failed, round(100.0 * n_rows_failed / n_rows_checked, 4)::DOUBLE AS pct_failed, coalesce(s, '') AS example_failing_rows, '' AS notes
FROM c LEFT JOIN x ON c.check_id = x.check_id""",
)
def quality_report(spark, sf):
    """Predicate checks with counts and the first failing rows."""
    checks = [
        Q.check_format("p_name", "^(small|red) [a-z]+$"),
        Q.check_enum("p_type", ["ECONOMY", "PROMO"], bad="WARN"),
        Q.check_range("p_size", 0, 45),
        Q.check_literal_null("p_brand"),
        Q.check_binary("p_size"),
        Q.check_only_where("p_brand", F.col("p_retailprice") < 1000, "cheap"),
    ]
    return Q.run_checks(D.table(spark, sf, "part"), checks, "p_partkey")


@query(
    "quality_sequences",
    f"""WITH {D.FRAMES_SQL},
m AS (SELECT k - lag(k) OVER (PARTITION BY trip ORDER BY t, ord) AS s FROM frames),
q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM frames),
x AS (SELECT a - 2 * abs(a) AS lo, b + 2 * abs(b) AS hi FROM q)
SELECT * FROM (
  SELECT 'k' AS column_name, 'k.monotone' AS check_id, 'FAIL' AS status, CAST(count(s) AS BIGINT) AS n_rows_checked, CAST(count(*) FILTER (s < -0.01) AS BIGINT) AS n_rows_failed FROM m
  UNION ALL SELECT 'value', 'value.box', CASE WHEN count(*) FILTER (value < lo OR value > hi) = 0 THEN 'PASS' ELSE 'WARN' END, count(value), count(*) FILTER (value < lo OR value > hi) FROM frames, x
  UNION ALL SELECT 'trip', 'trip+label.unique', 'FAIL', count(*), count(*) - count(DISTINCT (trip, label)) FROM frames
  UNION ALL SELECT 'label', 'label.single', 'FAIL', count(*), count(*) FILTER (n > 1) FROM (SELECT trip, count(DISTINCT label) AS n FROM frames GROUP BY trip)
  UNION ALL SELECT 'label', 'label.present_per.trip', CASE WHEN count(*) FILTER (NOT h) = 0 THEN 'PASS' ELSE 'WARN' END, count(*), count(*) FILTER (NOT h) FROM (SELECT trip, bool_or(label LIKE 'sign%') AS h FROM frames GROUP BY trip)
  UNION ALL SELECT 'trip', 'trip.rows_per_group', 'PASS', count(*), 0 FROM frames)""",
)
def quality_sequences(spark, sf):
    """Checks across rows: order, box, uniqueness, single values, presence, group sizes."""
    f = D.ordered_frames(spark, sf, "label", "value", "k")
    parts = [
        Q.check_monotone(f, ["trip"], "k", -0.01),
        Q.check_bounding_box(f, "value"),
        Q.check_unique(f, ["trip", "label"]),
        Q.check_single_value(f, ["trip"], "label"),
        Q.check_presence(f, "trip", "label", "^sign"),
        Q.check_rows_per_group(f, "trip"),
    ]
    return Q.report(*parts).select("column_name", "check_id", "status", "n_rows_checked", "n_rows_failed")


@query(
    "text_variants",
    """WITH v AS (SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line),
f AS (SELECT lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS f, count(*) AS spellings, sum(n) AS n FROM v GROUP BY 1)
SELECT 'line' AS column_name, 'line.variants' AS check_id, CASE WHEN count(*) FILTER (spellings > 1) = 0 THEN 'PASS' ELSE 'WARN' END AS status,
  CAST(sum(n) AS BIGINT) AS n_rows_checked, CAST(coalesce(sum(n) FILTER (spellings > 1), 0) AS BIGINT) AS n_rows_failed FROM f""",
)
def text_variants(spark, sf):
    """Lines of all documents that differ only in case or blanks."""
    lines = D.table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return Q.check_variants(lines, "line").select("column_name", "check_id", "status", "n_rows_checked", "n_rows_failed")


@query(
    "ragged_rows",
    """WITH r AS (SELECT text || CASE WHEN (length(text) - length(replace(text, '"', ''))) % 2 = 1 THEN '"' ELSE '' END AS v FROM documents WHERE text IS NOT NULL),
f AS (SELECT 1 + length(o) - length(replace(o, ',', '')) AS n_fields FROM (SELECT regexp_replace(v, '"[^"]*"', '', 'g') AS o FROM r))
SELECT CAST(n_fields AS INTEGER) AS n_fields, CAST(count(*) AS BIGINT) AS n_rows, CASE WHEN n_fields = 10 THEN 'ok' WHEN n_fields < 10 THEN 'short' ELSE 'long' END AS kind FROM f GROUP BY n_fields""",
)
def ragged_rows(spark, sf):
    """Whole document texts, quotes left in, as comma-separated records of any length."""
    d = D.table(spark, sf, "documents").where("text is not null").select(F.col("text").alias("value"))
    return Q.field_counts(Q.split_ragged(d), expected=10)


_ORDERS = (
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
)


def _profile_sql(c: str, kind: str) -> str:
    text = (lambda v: f"strftime({v}, '%Y-%m-%d %H:%M:%S')") if kind == "timestamp_ntz" else (lambda v: f"CAST({v} AS VARCHAR)")
    end = lambda f: text(f"(SELECT {c} FROM orders ORDER BY o_orderkey {f} LIMIT 1)")
    mean, sd = (f"round(avg({c}), 4)", f"round(stddev_samp({c}), 4)") if kind in ("bigint", "double") else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    return (
        f"SELECT count(*) AS rows, '{c}' AS column_name, '{kind}' AS type, CAST(count(*) - count({c}) AS BIGINT) AS nulls, {text(f'min({c})')} AS least, "
        f"{text(f'max({c})')} AS greatest, {mean} AS mean, {sd} AS sd, {end('ASC')} AS first, {end('DESC')} AS last, true AS distinct_close FROM orders"
    )


@query("profile", "\nUNION ALL ".join(_profile_sql(*c) for c in _ORDERS))
def profile(spark, sf):
    """All columns of the orders; the distinct estimates are held against exact counts."""
    orders = D.table(spark, sf, "orders")
    names = [c for c, _ in _ORDERS]
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in names]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("_n")) for c in names])))
    shown = logs.profile(orders, order=["o_orderkey"]).join(exact, "column_name")
    close = F.abs(F.col("distinct_estimate") - F.col("_n")) <= 0.06 * F.col("_n") + 0.5
    return shown.select(
        "rows", "column_name", "type", "nulls", "least", "greatest", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "first", "last", close.alias("distinct_close")
    )


@query(
    "canonical_sink_antijoin",
    f"""WITH {D.FRAMES_SQL}, done AS (SELECT DISTINCT trip FROM frames WHERE label = 'error' AND k = 0)
SELECT CAST(f.trip AS VARCHAR) AS "Id", f.t AS "SimulationTime", f.value AS "Speed", f.label AS "SpacialEvent", CAST(NULL AS VARCHAR) AS "text", CAST(NULL AS INTEGER) AS "Braking"
FROM frames f WHERE f.trip NOT IN (SELECT trip FROM done)""",
)
def canonical_sink_antijoin(spark, sf):
    """Rows in the fixed output layout, for trips the output does not hold yet."""
    f = D.frames(spark, sf)
    shaped = f.select(F.col("trip").cast("string").alias("Id"), F.lit("Avatar").alias("Condition"), F.lit("A").alias("Map"),
                      F.col("t").alias("SimulationTime"), F.col("value").alias("Speed"), F.col("label").alias("SpacialEvent"), "k")
    done = shaped.where("SpacialEvent = 'error' and k = 0")
    left = sinks.canonical(logs.pending(shaped, done))
    return left.select("Id", "SimulationTime", "Speed", "SpacialEvent", "text", "Braking")
