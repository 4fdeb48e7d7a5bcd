"""Model fits on the shipped tables, iterative and so without SQL twins, and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.catalog.stats import normal_p_sql
from roadlens.catalog.windows import cells
from roadlens.functions import linear as LA
from roadlens.operators import models as M
from roadlens.operators import nearest as NP
from roadlens.operators import smote as SM
from roadlens.operators import stats as ST
from roadlens.operators import windows as W
from roadlens.session import materialize
from roadlens.sources import shipped as D
from roadlens.sources import shipped_windows as V

_FEATURES = ["Speed_mean", "Brake_max", "Acceleration_max", "SteeringAngle_absmax", "TTC_min"]


def _merged(spark, sf):
    # the merge numbers windows in a written order, through which no column is pruned and whose sampling computes its input twice
    win = V.features(spark, sf).select("event_id", "window_index", *_FEATURES, (F.col("Speed_max") > 80).cast("int").alias("soon"))
    return W.n_row_windows(materialize(win, "windows"), n=2, horizon=2, target="soon")


@query("grid_auc")
def grid_auc(spark, sf):
    """AUC of a logistic model in every window x horizon cell, all cells fitted together."""
    return M.grid_auc(cells(spark, sf), ["TTC_min", "Speed_mean"])


@query(
    "logistic_documents",
    f"""WITH RECURSIVE {D.OUTCOME_SQL},
o AS MATERIALIZED (SELECT ln(1 + score) AS x, CAST(y AS DOUBLE) AS y FROM outcome WHERE score IS NOT NULL AND y IS NOT NULL),
b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS v0, CAST(0 AS DOUBLE) AS v1 UNION ALL
  SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), h11 / (h00 * h11 - h01 * h01), h00 / (h00 * h11 - h01 * h01)
  FROM (SELECT i, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
    FROM (SELECT i, b0, b1, x, y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM b CROSS JOIN o WHERE i < 25) GROUP BY i, b0, b1)),
t AS (SELECT unnest(['intercept', 'log_length']) AS feature, unnest([b0, b1]) AS c, unnest([sqrt(v0), sqrt(v1)]) AS s FROM b WHERE i = 25)
SELECT feature, round(c, 6) AS coef, round(exp(c), 6) AS odds_ratio, round(exp(c - 1.959963984540054 * s), 6) AS ci_lower, round(exp(c + 1.959963984540054 * s), 6) AS ci_upper,
  round({normal_p_sql('c / s')}, 8) AS p, true AS converged FROM t""",
)
def logistic_documents(spark, sf):
    """Toxic documents by length: coefficient, odds ratio and p of a plain logit."""
    o = D.outcome(spark, sf).withColumn("log_length", F.log1p("score"))
    fit = M.logistic(o, ["log_length"], "y", balanced=False, penalty=0.0)[0]
    rows = [(t["feature"], t["coef"], t["odds_ratio"], t["ci_lower"], t["ci_upper"], t["p"], fit["converged"]) for t in fit["terms"]]
    out = spark.createDataFrame(rows, "feature string, coef double, odds_ratio double, ci_lower double, ci_upper double, p double, converged boolean")
    return out.withColumns({c: F.round(c, 8 if c == "p" else 6) for c in ("coef", "odds_ratio", "ci_lower", "ci_upper", "p")})


@query("cross_validation")
def cross_validation(spark, sf):
    """Grouped five-fold run of a logistic model on merged windows."""
    return M.fold_summary(M.cross_validate(_merged(spark, sf), _FEATURES))


_DIRECTIONS, _PHASES = M.fourier_weights(3, 16, 0.5)


def _wave_sql(x: str) -> str:
    terms = [f"cos({' + '.join(f'({v!r}) * {x}[{i + 1}]' for i, v in enumerate(w))} + {b!r})" for w, b in zip(_DIRECTIONS, _PHASES)]
    return f"list_transform([{', '.join(terms)}], lambda c: c * sqrt(2.0 / {len(_PHASES)}))"


@query(
    "kernel_features",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda e: CAST(e AS DOUBLE) * 5) AS x FROM embeddings),
w AS (SELECT vec_id, {_wave_sql('x')} AS z FROM v), o AS (SELECT z AS z0 FROM w WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(z, z0), 9) AS kernel FROM w CROSS JOIN o""",
)
def kernel_features(spark, sf):
    """Approximate kernel of every vector with the first one, from random Fourier features."""
    x = F.transform(F.slice("embedding", 1, 3), lambda e: e.cast("double") * 5)
    w = D.table(spark, sf, "embeddings").select("vec_id", M.fourier_features(x, _DIRECTIONS, _PHASES).alias("z"))
    first = F.array(*[F.lit(v) for v in w.where("vec_id = 0").first()["z"]])
    return w.select("vec_id", F.round(LA.dot(F.col("z"), first), 9).alias("kernel"))


@query("boosted_trees")
def boosted_trees(spark, sf):
    """Importances and training AUC of boosted trees."""
    data = materialize(_merged(spark, sf).select(*_FEATURES, "feedback_next"), "merged")
    model = M.fit_classifier("boost", data, _FEATURES, "feedback_next", rounds=50)
    auc = ST.roc_auc(M.classifier_scores(model, data, _FEATURES), "score", "feedback_next").first()["auc"]
    return spark.createDataFrame([(f, v, auc) for f, v in M.importances(model, _FEATURES)], "feature string, importance double, auc double")


@query(
    "nearest_vectors",
    """WITH v AS (SELECT min(vec_id) AS vec_id, list_transform(embedding[1:12], lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings GROUP BY x),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.x, b.x) AS d, b.x AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, y) AS place FROM p)
SELECT vec_id, neighbour_id, round(d, 9) AS distance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""",
)
def nearest_vectors(spark, sf):
    """Five nearest other vectors of every vector in twelve dimensions."""
    x = F.transform(F.slice("embedding", 1, 12), lambda e: e.cast("double"))
    v = D.table(spark, sf, "embeddings").select("vec_id", x.alias("x")).groupBy("x").agg(F.min("vec_id").alias("vec_id"))
    near = NP.nearest_points(v, 12, 5, leaf_rows=64)
    other = v.select(F.col("x").alias("neighbour"), F.col("vec_id").alias("neighbour_id"))
    return near.join(v, "x").join(other, "neighbour").select("vec_id", "neighbour_id", F.round("distance", 9).alias("distance"), "place")


@query(
    "smote_orders",
    """WITH o AS (SELECT o_totalprice / 100000 AS price, o_custkey / 1000 AS cust, CAST(o_orderstatus = 'P' AS INTEGER) AS y FROM orders),
c AS (SELECT y, min(price) AS a, max(price) AS b, min(cust) AS c, max(cust) AS d, count(*) AS n FROM o GROUP BY y)
SELECT y, CAST(max(n) OVER () AS BIGINT) AS n, round(a, 9) AS min_price, round(b, 9) AS max_price, round(c, 9) AS min_cust, round(d, 9) AS max_cust, CAST(0 AS BIGINT) AS off_line FROM c""",
)
def smote_orders(spark, sf):
    """Orders in part delivery raised to the size of the rest: class sizes, ranges (new rows lie between old ones), and rows that do not lie
    on the line between the old row that they start from and one of its five nearest, or a copy of it."""
    li = D.table(spark, sf, "orders").select(
        (F.col("o_totalprice") / 100000).alias("price"), (F.col("o_custkey") / 1000).alias("cust"), (F.col("o_orderstatus") == "P").cast("int").alias("y")
    )
    made = materialize(SM.smote(li, ["price", "cust"], "y", ends=True), "smote-made")
    bounds = [F.round(f(c), 9).alias(f"{n}_{c}") for c in ("price", "cust") for n, f in (("min", F.min), ("max", F.max))]
    sizes = made.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *bounds)
    few = li.where("y = 1").select(F.array(F.col("price"), F.col("cust")).alias("x"))
    lines = NP.nearest_points(few, 2, 5).select("x", "neighbour").unionByName(few.distinct().withColumn("neighbour", F.col("x")))
    part = lambda c, i: F.get(c, F.lit(i))
    side = (part("end", 0) - part("start", 0)) * (F.col("cust") - part("start", 1)) - (part("end", 1) - part("start", 1)) * (F.col("price") - part("start", 0))
    within = [F.col(c).between(F.least(part("start", i), part("end", i)) - 1e-9, F.greatest(part("start", i), part("end", i)) + 1e-9) for i, c in enumerate(("price", "cust"))]
    on = (F.abs(side) < 1e-9) & within[0] & within[1] & (F.col("start") == F.col("x")) & (F.col("end") == F.col("neighbour"))
    off = made.where("start is not null").join(lines, on, "left_anti").select("y")
    lost = off.groupBy("y").agg(F.count(F.lit(1)).alias("off_line"))
    return sizes.join(lost, "y", "left").withColumn("off_line", F.coalesce("off_line", F.lit(0).cast("long")))
