"""Statistics on the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.operators import scan as S
from roadlens.operators import stats as ST
from roadlens.operators import survival as SV
from roadlens.operators import windows as W
from roadlens.operators.quantiles import average_ranks, exact_quantiles
from roadlens.sources import shipped as D

# line items as a scoring problem: is the item returned, scored by its price
_RET_SQL = "r AS (SELECT l_linestatus AS g, l_extendedprice AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"


def _returns(spark, sf):
    li = D.table(spark, sf, "lineitem")
    return li.select(F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


_RANKED = "k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS rk FROM r)"


@query(
    "auc_exact",
    f"""WITH {_RET_SQL}, {_RANKED}
SELECT g, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives,
  round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) AS auc FROM k GROUP BY g""",
)
def auc_exact(spark, sf):
    return ST.roc_auc(_returns(spark, sf), "score", "y", keys=["g"]).withColumn("auc", F.round("auc", 8))


@query(
    "auc_documents",
    f"""WITH {D.OUTCOME_SQL}, p AS (SELECT a.score AS sa, b.score AS sb FROM outcome a, outcome b WHERE a.y = 1 AND b.y = 0)
SELECT CAST((SELECT sum(y) FROM outcome) AS BIGINT) AS positives, CAST((SELECT sum(1 - y) FROM outcome) AS BIGINT) AS negatives,
  round(avg(CASE WHEN sa > sb THEN 1.0 WHEN sa = sb THEN 0.5 ELSE 0 END), 8) AS auc FROM p""",
)
def auc_documents(spark, sf):
    """Does document length tell toxic documents apart?"""
    return ST.roc_auc(D.outcome(spark, sf), "score", "y").withColumn("auc", F.round("auc", 8))


def _simpson(f: str, top: str, steps: int = 2000) -> str:
    """Integral from 0 to ``top`` of an expression in ``v``."""
    at = f"(i * ({top}) / {steps})"
    return f"(({top}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('v', at)})))"


def normal_p_sql(z: str) -> str:
    return f"greatest(0, 1 - sqrt(2 / pi()) * {_simpson('exp(-v * v / 2)', f'least(abs({z}), 12)')})"


def _student_p_sql(t: str, n: str) -> str:
    """The angle whose tangent is t / sqrt(n) makes the density a power of the cosine."""
    scale = f"exp(lgamma((({n}) + 1) / 2) - lgamma(({n}) / 2)) / sqrt(pi())"
    return f"(1 - 2 * {scale} * {_simpson(f'pow(cos(v), ({n}) - 1)', f'atan(abs({t}) / sqrt({n}))')})"


@query(
    "student_fit",
    f"""WITH RECURSIVE p AS (SELECT o_custkey AS g, epoch(o_orderdate) / 86400000.0 AS x, o_totalprice / 100000 AS y FROM orders),
f AS MATERIALIZED (SELECT g, CAST(count(*) AS DOUBLE) AS c, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, corr(y, x) AS r, avg(x) AS m, regr_sxx(y, x) AS ss
  FROM p GROUP BY g HAVING count(*) >= 3 AND corr(y, x) * corr(y, x) < 1),
e AS MATERIALIZED (SELECT f.*, rmse, r * sqrt((c - 2) / (1 - r * r)) AS t FROM f JOIN (SELECT g, sqrt(avg((y - i - s * x) * (y - i - s * x))) AS rmse FROM p JOIN f USING (g) GROUP BY g) USING (g)),
b AS (SELECT DISTINCT c - 2 AS n, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, 0 AS k FROM f UNION ALL
  SELECT n, CASE WHEN {_student_p_sql('tan((low + high) * pi() / 4) * sqrt(n)', 'n')} > 0.05 THEN (low + high) / 2 ELSE low END,
    CASE WHEN {_student_p_sql('tan((low + high) * pi() / 4) * sqrt(n)', 'n')} > 0.05 THEN high ELSE (low + high) / 2 END, k + 1 FROM b WHERE k < 48),
q AS (SELECT n, tan((low + high) * pi() / 4) * sqrt(n) AS crit FROM b WHERE k = 48)
SELECT g, CAST(c AS BIGINT) AS n, round(r, 8) AS r, round(t, 8) AS t, round({_student_p_sql('t', 'c - 2')}, 8) AS p,
  round(i + s * (m + 1) - crit * rmse * sqrt(1 / c + 1 / ss), 6) AS lower, round(i + s * (m + 1) + crit * rmse * sqrt(1 / c + 1 / ss), 6) AS upper
FROM e JOIN q ON q.n = e.c - 2""",
)
def student_fit(spark, sf):
    """Order value on time for each customer: correlation with Student's p, and the 95 % band of the line a thousand days past the middle."""
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), (D.days("o_orderdate") / 1000).alias("x"), (F.col("o_totalprice") / 100000).alias("y"))
    r = ST.pearson(o, "x", "y", keys=["g"]).where("n >= 3 AND r * r < 1")
    fit = ST.ols(o, "x", "y", keys=["g"])
    band = ST.ols_band(fit, fit.select("g", (F.col("x_mean") + 1).alias("x")), "x")
    out = r.join(band.drop("x"), "g")
    return out.select("g", "n", *[F.round(c, 8).alias(c) for c in ("r", "t", "p")], *[F.round(c, 6).alias(c) for c in ("lower", "upper")])


@query(
    "mann_whitney",
    f"""WITH {_RET_SQL}, {_RANKED},
t AS (SELECT g, sum(CAST(n AS DOUBLE) * n * n - n) AS tie FROM (SELECT g, score, count(*) AS n FROM r GROUP BY g, score) GROUP BY g),
s AS (SELECT g, CAST(sum(1 - y) AS DOUBLE) AS n0, CAST(sum(y) AS DOUBLE) AS n1, sum(CASE WHEN y = 0 THEN rk END) AS r0 FROM k GROUP BY g),
u AS (SELECT s.*, tie, r0 - n0 * (n0 + 1) / 2 AS u FROM s JOIN t USING (g))
SELECT g, n0, n1, u, round(z, 8) AS z, round(least(1, CASE WHEN z < 0 THEN 2 - {normal_p_sql('z')} ELSE {normal_p_sql('z')} END), 8) AS p FROM (
  SELECT g, n0, n1, u, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - tie / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM u)""",
)
def mann_whitney(spark, sf):
    out = ST.mann_whitney(_returns(spark, sf), "score", "y", keys=["g"])
    return out.select("g", "n0", "n1", "u", F.round("z", 8).alias("z"), F.round("p", 8).alias("p"))


@query(
    "average_ranks",
    """WITH k AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem)
SELECT g, v, CAST(count(*) AS BIGINT) AS ties, min(rk) AS rank FROM (
  SELECT g, v, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS rk FROM k) GROUP BY g, v""",
)
def avg_ranks(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"))
    return average_ranks(li, ["g"], "v")


_CURVE = f"""{_RET_SQL}, d AS (SELECT g, score, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY g, score),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY g) AS pp FROM d
  WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS pr, CAST(tp AS DOUBLE) / pp AS rc FROM c),
h AS (SELECT *, 2 * pr * rc / (pr + rc + 1e-9) AS f1 FROM f)"""


@query(
    "pr_threshold",
    f"""WITH {_CURVE}, b AS (SELECT g, score, f1, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, score) AS rn FROM h)
SELECT g, score AS threshold, round(f1, 8) AS f1 FROM b WHERE rn = 1""",
)
def pr_threshold(spark, sf):
    """Threshold with the best F1 on the precision-recall curve."""
    return ST.best_threshold(_returns(spark, sf), "score", "y", keys=["g"]).withColumn("f1", F.round("f1", 8))


@query(
    "class_metrics",
    f"""WITH {_RET_SQL}, m AS (SELECT g, count(*) FILTER (score >= 40000 AND y = 1) AS tp, count(*) FILTER (score >= 40000 AND y = 0) AS fp,
  count(*) FILTER (score < 40000 AND y = 1) AS fn FROM r GROUP BY g)
SELECT g, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 8) AS precision,
  round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM m""",
)
def class_metrics(spark, sf):
    out = ST.class_metrics(_returns(spark, sf), "score", "y", 40000.0, keys=["g"])
    return out.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query(
    "quantiles",
    """SELECT l_shipmode AS flag, q1, q2, q3 FROM (SELECT l_returnflag AS l_shipmode, round(quantile_cont(l_extendedprice, 0.01), 6) AS q1,
  round(median(l_extendedprice), 6) AS q2, round(quantile_cont(l_extendedprice, 0.99), 6) AS q3 FROM lineitem GROUP BY l_returnflag)""",
)
def quantiles(spark, sf):
    q = exact_quantiles(D.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.01, "q2": 0.5, "q3": 0.99})
    return q.select(F.col("l_returnflag").alias("flag"), *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


@query(
    "ols_fit",
    """WITH p AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
f AS (SELECT g, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, corr(y, x) AS r FROM p GROUP BY g)
SELECT g, CAST(n AS BIGINT) AS n, round(any_value(slope), 6) AS slope, round(any_value(intercept), 6) AS intercept, round(any_value(r2), 6) AS r2,
  round(avg(abs(y - intercept - slope * x)), 6) AS mae, round(sqrt(avg((y - intercept - slope * x) * (y - intercept - slope * x))), 6) AS rmse,
  round(any_value(r), 6) AS r FROM p JOIN f USING (g) GROUP BY g, n""",
)
def ols_fit(spark, sf):
    """Price on quantity per return flag, with the correlation."""
    p = D.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = ST.ols(p, "x", "y", keys=["g"]).join(ST.pearson(p, "x", "y", keys=["g"]).select("g", "r"), "g")
    return fit.select("g", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "mae", "rmse", "r")])


@query(
    "bins_rate",
    f"""WITH {_RET_SQL}, b AS (SELECT y, CASE WHEN score > 0 AND score <= 10000 THEN 0 WHEN score > 10000 AND score <= 20000 THEN 1
  WHEN score > 20000 AND score <= 50000 THEN 2 WHEN score > 50000 AND score <= 70000 THEN 3 END AS bin FROM r)
SELECT bin, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS hits, round(avg(y), 8) AS rate FROM b WHERE bin IS NOT NULL GROUP BY bin""",
)
def bins_rate(spark, sf):
    return ST.bin_rate(_returns(spark, sf), "score", "y", [0, 10000, 20000, 50000, 70000]).withColumn("rate", F.round("rate", 8))


@query(
    "hazard_by_second",
    f"""WITH {D.FRAMES_SQL}, h AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS hour, label FROM frames)
SELECT hour, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (label = 'purchase') AS BIGINT) AS hits,
  round(count(*) FILTER (label = 'purchase') / count(*), 8) AS rate FROM h GROUP BY hour HAVING count(*) >= 5""",
)
def hazard_by_second(spark, sf):
    f = D.frames(spark, sf).select(F.floor(F.col("t") / 3600).cast("long").alias("hour"), (F.col("label") == "purchase").cast("int").alias("hit"))
    return ST.hazard(f, "hour", "hit").withColumn("rate", F.round("rate", 8))


@query(
    "histogram",
    f"""WITH {_RET_SQL}, b AS (SELECT y, least(CAST(floor((score - 900) / 2000) AS INTEGER), 39) AS bin FROM r WHERE score >= 900 AND score <= 80900),
c AS (SELECT y, bin, count(*) AS n FROM b GROUP BY y, bin)
SELECT y, bin, CAST(n AS BIGINT) AS n, round(n / (sum(n) OVER (PARTITION BY y) * 2000.0), 12) AS density FROM c""",
)
def histogram(spark, sf):
    return ST.histogram(_returns(spark, sf), "score", 900, 80900, 40, keys=["y"]).withColumn("density", F.round("density", 12))


@query(
    "density",
    f"""WITH {_RET_SQL}, s AS (SELECT y, count(*) AS n, stddev_samp(score) * pow(count(*), -0.2) AS h FROM r GROUP BY y),
x AS (SELECT unnest(generate_series(0, 20)) * 5000.0 AS x)
SELECT y, CAST(x AS DOUBLE) AS x, round(sum(exp(-((x - score) / h) * ((x - score) / h) / 2) / (h * sqrt(2 * pi()))) / n * 1000, 8) AS density FROM r JOIN s USING (y), x GROUP BY y, x, n""",
)
def density(spark, sf):
    out = ST.density(_returns(spark, sf), "score", 0.0, 100000.0, 21, keys=["y"])
    return out.withColumn("density", F.round(F.col("density") * 1000, 8))


@query(
    "standardize",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_tax) AS b, stddev_pop(l_tax) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / s, 8) AS l_quantity, round((l_tax - b) / t, 8) AS l_tax FROM lineitem, m""",
)
def standardize(spark, sf):
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return ST.standardize(li, ["l_quantity", "l_tax"]).withColumns({c: F.round(c, 8) for c in ("l_quantity", "l_tax")})


@query(
    "anova_f",
    """WITH l AS (UNPIVOT (SELECT l_returnflag AS y, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v),
p AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY feature, y),
g AS (SELECT feature, avg(v) AS g, count(*) AS nn, count(DISTINCT y) AS k FROM l GROUP BY feature)
SELECT feature, round((sum(n * (m - g) * (m - g)) / (k - 1)) / (sum(n * s) / (nn - k)), 5) AS f_value FROM p JOIN g USING (feature) GROUP BY feature, k, nn""",
)
def anova_f(spark, sf):
    li = D.table(spark, sf, "lineitem")
    out = ST.anova_f(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")
    return out.withColumn("f_value", F.round("f_value", 5))


@query(
    "top_values",
    """SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""",
)
def top_values(spark, sf):
    """The ten most sold brands."""
    sold = D.table(spark, sf, "lineitem").select("l_partkey").join(D.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return ST.top_values(sold, "p_brand", 10)


@query(
    "pivot_metrics",
    """SELECT l_linenumber, round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 4) AS A, round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 4) AS N,
  round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS R FROM lineitem GROUP BY l_linenumber""",
)
def pivot_metrics(spark, sf):
    means = D.table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("m"))
    return ST.pivot_metrics(means, "l_linenumber", "l_returnflag", "m", ["A", "N", "R"])


@query(
    "corr_by_group",
    f"""WITH {D.FRAMES_SQL}, d AS (SELECT trip, value - lag(value) OVER w AS dv, k - lag(k) OVER w AS dk, t - lag(t) OVER w AS dt FROM frames
  WINDOW w AS (PARTITION BY trip ORDER BY t, ord))
SELECT trip, round(corr(dv, dk), 6) AS corr_value_k, round(corr(dv, dt), 6) AS corr_value_t, round(least(abs(corr(dv, dk)), abs(corr(dv, dt))), 6) AS weakest FROM d GROUP BY trip""",
)
def corr_by_group(spark, sf):
    out = ST.corr_by_group(D.ordered_frames(spark, sf, "value", "k"), ["trip"], [("value", "k"), ("value", "t")])
    return out.withColumns({c: F.round(c, 6) for c in ("corr_value_k", "corr_value_t", "weakest")})


# --- survival: orders until their last shipment, censored unless fully shipped -----------------

_SHIP_SQL = """ship AS (SELECT o_orderpriority AS g, CAST(epoch(max(l_shipdate) - any_value(o_orderdate)) / 86400 AS BIGINT) AS duration,
  CAST(any_value(o_orderstatus) = 'F' AS INTEGER) AS event, CAST(any_value(o_totalprice) > 200000 AS INTEGER) AS grp,
  CAST(floor(any_value(o_totalprice) / 100) AS BIGINT) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)"""


def _shipments(spark, sf):
    li = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    o = D.table(spark, sf, "orders").join(li, "o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("g"), F.rint(D.days("s") - D.days("o_orderdate")).cast("long").alias("duration"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"), (F.col("o_totalprice") > 200000).cast("int").alias("grp"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("score"),
    )


_AT_RISK = """c AS (SELECT g, duration AS time, sum(event) AS d, count(*) AS leaving FROM ship GROUP BY g, duration),
n AS (SELECT *, sum(leaving) OVER (PARTITION BY g ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM c)"""


@query(
    "km_curve",
    f"""WITH {_SHIP_SQL}, {_AT_RISK},
s AS (SELECT *, sum(CASE WHEN d < r THEN ln(1 - d / r) END) OVER w AS ls, sum(CAST(d = r AS INTEGER)) OVER w AS z,
  sum(CASE WHEN d < r THEN d / (r * (r - d)) END) OVER w AS v FROM n WINDOW w AS (PARTITION BY g ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT g, time, CAST(r AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS d, round(CASE WHEN z > 0 THEN 0 ELSE exp(ls) END, 8) AS survival,
  round(CASE WHEN z = 0 AND ls < 0 THEN exp(-exp(ln(-ls) - 1.959963984540054 * sqrt(v) / ls)) END, 8) AS lower,
  round(CASE WHEN z = 0 AND ls < 0 THEN exp(-exp(ln(-ls) + 1.959963984540054 * sqrt(v) / ls)) END, 8) AS upper FROM s""",
)
def km_curve(spark, sf):
    """Survival of orders per priority until shipped."""
    out = SV.kaplan_meier(_shipments(spark, sf), "duration", "event", keys=["g"])
    return out.withColumns({c: F.round(c, 8) for c in ("survival", "lower", "upper")})


@query(
    "km_median",
    f"""WITH {D.FRAMES_SQL}, {D.SURVIVAL_SQL}, c AS (SELECT grp, duration AS time, sum(event) AS d, count(*) AS m FROM surv GROUP BY grp, duration),
n AS (SELECT *, sum(m) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM c),
s AS (SELECT *, product(1 - d / r) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS surv FROM n)
SELECT grp, min(CASE WHEN surv <= 0.5 THEN time END) AS median FROM s GROUP BY grp""",
)
def km_median(spark, sf):
    """Median time of users to their first later purchase, by mean value."""
    curve = SV.kaplan_meier(D.survival(spark, sf), "duration", "event", keys=["grp"])
    return SV.median_survival(curve, keys=["grp"])


@query(
    "logrank",
    f"""WITH {_SHIP_SQL}, c AS (SELECT g, duration AS t, sum(event) AS d, sum(event * grp) AS d1, count(*) AS m, sum(grp) AS m1 FROM ship GROUP BY g, duration),
n AS (SELECT *, sum(m) OVER w AS r, sum(m1) OVER w AS r1 FROM c WINDOW w AS (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT g, sum(d1) AS o, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) END) AS v FROM n GROUP BY g)
SELECT g, CAST(o AS BIGINT) AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) * (o - e) / v, 6) AS chi2,
  round({normal_p_sql('(o - e) / sqrt(v)')}, 8) AS p FROM q""",
)
def logrank(spark, sf):
    out = SV.log_rank(_shipments(spark, sf), "duration", "event", "grp", keys=["g"])
    return out.select("g", "observed", *[F.round(c, 6).alias(c) for c in ("expected", "variance", "chi2")], F.round("p", 8).alias("p"))


@query(
    "cindex",
    f"""WITH {_SHIP_SQL}, d AS (SELECT g, duration AS t, score AS s, event AS e, count(*) AS m FROM ship GROUP BY g, duration, score, event),
p AS (SELECT a.g, CAST(a.m * b.m AS DOUBLE) AS w, a.s AS sa, b.s AS sb FROM d a JOIN d b ON a.g = b.g AND a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))
SELECT g, sum(CASE WHEN sb > sa THEN w ELSE 0 END) AS concordant, sum(CASE WHEN sb = sa THEN w ELSE 0 END) AS tied, sum(w) AS pairs,
  round((sum(CASE WHEN sb > sa THEN w ELSE 0 END) + sum(CASE WHEN sb = sa THEN w ELSE 0 END) / 2) / sum(w), 8) AS c_index FROM p GROUP BY g""",
)
def cindex(spark, sf):
    """Concordance of order value and shipping time, per priority."""
    out = SV.concordance(_shipments(spark, sf), "duration", "score", "event", keys=["g"])
    return out.withColumn("c_index", F.round("c_index", 8))


def _purchase_intervals(spark, sf):
    """Hours from each event of a user to the next, with its value; the event of the interval is a purchase."""
    f = D.ordered_frames(spark, sf, "label", "value", "k")
    rows = S.scan(f, ["trip"], next_t=S.lead("t"), next_label=S.lead("label")).where("next_t is not null")
    return rows.select(
        F.floor(F.col("t") / 3600).alias("start_time"), F.floor(F.col("next_t") / 3600).alias("end_time"),
        (F.col("next_label") == "purchase").cast("int").alias("event"), "value", "k",
    )


@query(
    "cox_score",
    f"""WITH {D.FRAMES_SQL},
n AS (SELECT floor(t / 3600) AS a, floor(lead(t) OVER w / 3600) AS b, lead(label) OVER w = 'purchase' AS e, coalesce(value, 0) AS x, coalesce(k, 0) AS y
  FROM frames WINDOW w AS (PARTITION BY trip ORDER BY t, ord)),
q AS MATERIALIZED (SELECT a, b, e, x, y, 0.01 * x - 0.005 * y AS eta, exp(0.01 * x - 0.005 * y) AS w FROM n WHERE b IS NOT NULL AND a < b),
dt AS (SELECT b AS time, count(*) AS d, sum(eta) AS eta, sum(x) AS x, sum(y) AS y, sum(w) AS d_, sum(w * x) AS dx, sum(w * y) AS dy, sum(w * x * x) AS dxx,
  sum(w * x * y) AS dxy, sum(w * y * y) AS dyy FROM q WHERE e GROUP BY b),
rs AS (SELECT time, sum(w) AS s_, sum(w * q.x) AS sx, sum(w * q.y) AS sy, sum(w * q.x * q.x) AS sxx, sum(w * q.x * q.y) AS sxy, sum(w * q.y * q.y) AS syy
  FROM dt JOIN q ON q.a < time AND time <= q.b GROUP BY time),
l AS (SELECT *, unnest(range(d)) AS i FROM dt JOIN rs USING (time)),
p AS (SELECT *, i / d AS f, s_ - i / d * d_ AS z, (sx - i / d * dx) / (s_ - i / d * d_) AS mx, (sy - i / d * dy) / (s_ - i / d * d_) AS my FROM l)
SELECT round(sum(CASE WHEN i = 0 THEN eta ELSE 0 END - ln(z)), 4) AS ll, round(sum(CASE WHEN i = 0 THEN x ELSE 0 END - mx), 4) AS g0, round(sum(CASE WHEN i = 0 THEN y ELSE 0 END - my), 4) AS g1,
  round(sum((sxx - f * dxx) / z - mx * mx), 3) AS h0_0, round(sum((sxy - f * dxy) / z - mx * my), 3) AS h0_1, round(sum((syy - f * dyy) / z - my * my), 3) AS h1_1 FROM p""",
)
def cox_score(spark, sf):
    """Log likelihood, gradient and information of the Cox model of purchases at fixed coefficients."""
    out = SV.cox_score(_purchase_intervals(spark, sf), ["value", "k"], [0.01, -0.005])
    return out.select(*[F.round(c, 4).alias(c) for c in ("ll", "g0", "g1")], *[F.round(c, 3).alias(c) for c in ("h0_0", "h0_1", "h1_1")])


@query("cox_orders")
def cox_orders(spark, sf):
    """Time-varying Cox model of events: does the value of an event change the rate of purchases?"""
    rows = _purchase_intervals(spark, sf)
    fits = SV.cox_univariate(rows, ["value", "k"]) + [dict(f, feature="joint " + f["feature"]) for f in SV.cox(rows, ["value", "k"], penalizer=0.1)]
    return spark.createDataFrame([(f["feature"], f["coef"], f["hr"], f["ci_lower"], f["ci_upper"], f["p"]) for f in fits],
                                 "feature string, coef double, hr double, ci_lower double, ci_upper double, p double")
