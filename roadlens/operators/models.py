"""Classifiers on window tables.

The logistic fits are Newton steps over aggregated sums, so all cells of a grid
share every pass over the data. Trees and the linear support-vector classifier
come from ``pyspark.ml``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import classification as MC
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import linear as LA
from roadlens.operators import joins as J
from roadlens.operators import stats as ST
from roadlens.operators import windows as W
from roadlens.operators.quantiles import exact_quantiles
from roadlens.session import materialize


def class_weights(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``weight`` = n / (2 * n of the row's class), per key."""
    keys = list(keys)
    base, group = ST._keyed(df, keys)
    counts = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p"))
    mine = F.when(F.col(y) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    joined = J.lookup(base, counts, group).withColumn("weight", F.col("_n") / (2 * mine))
    return ST._unkeyed(joined.drop("_n", "_p"))


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    *,
    keys: Sequence[str] = (),
    balanced: bool = True,
    penalty: float = 1.0,
    min_class: int = 1,
    max_iter: int = 50,
    tol: float = 1e-8,
) -> DataFrame:
    """Logistic regressions of any number of keys at once: one row a key with ``n, positives, beta, se, converged, fitted``.

    Each minimises weighted log loss + penalty/2 * |coef|^2; ``beta`` starts with the intercept. ``penalty=0, balanced=False`` is the
    plain maximum-likelihood fit with meaningful standard errors. Keys with fewer than ``min_class`` rows of a class have no
    coefficients. ``converged`` tells whether the steps came below ``tol`` within ``max_iter`` of them; perfectly separable data never do.

    A Newton step joins each row to its key's coefficients, adds up k and k x k numbers a key, and solves the systems as columns. Coefficients
    stay in a table of one row a key; the driver only asks whether any key is left.
    """
    keys, k = list(keys), len(features) + 1
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    key = F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit("all").alias("_all"))
    rows = df.select(key.alias("g"), x.alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumn("weight", F.lit(1.0)) if not balanced else class_weights(rows, "y", ["g"])
    rows = materialize(rows, "logistic")
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))
    zero = F.array_repeat(F.lit(0.0), k)
    none = F.array_repeat(F.lit(None).cast("double"), k)
    start = counts.withColumn("fitted", F.least(F.col("positives"), F.col("n") - F.col("positives")) >= min_class)
    state = materialize(start.select("*", zero.alias("beta"), none.alias("se"), (~F.col("fitted")).alias("done")), "logistic-state")
    ridge = [0.0] + [float(penalty)] * (k - 1)
    xi = [F.get("x", F.lit(i)) for i in range(k)]
    for _ in range(max_iter):
        live = state.where("not done")
        if live.isEmpty():
            break
        now = J.lookup(rows, live.select("g", "beta"), ["g"]).withColumn("p", 1 / (1 + F.exp(-LA.dot(F.col("x"), F.col("beta")))))
        curve = F.col("weight") * F.col("p") * (1 - F.col("p"))
        aggs = [F.sum(F.col("weight") * (F.col("y") - F.col("p")) * xi[i]).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum(curve * xi[i] * xi[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        sums = live.select("g", "beta").join(now.groupBy("g").agg(*aggs), "g")
        grad = F.array(*[F.col(f"g{i}") - ridge[i] * F.get("beta", F.lit(i)) for i in range(k)])
        hess = LA.symmetric([[F.col(f"h{i}_{j}") + (ridge[i] if i == j else 0.0) for j in range(i, k)] for i in range(k)])
        solved = sums.select("g", "beta", hess.alias("_h"), grad.alias("_r")).select("g", "beta", LA.solve(F.col("_h"), F.col("_r"), k).alias("_s"))
        # damp steps that would overshoot into saturation
        size = F.array_max(F.transform("_s.x", F.abs))
        step = F.transform("_s.x", lambda v: v * F.least(F.lit(1.0), 10.0 / F.greatest(size, F.lit(1e-300))))
        moved = solved.select(
            "g", F.zip_with("beta", step, lambda b, v: b + v).alias("_b"), F.least(size, F.lit(10.0)).alias("_size"),
            F.transform("_s.inverse", lambda row, i: F.sqrt(F.greatest(F.get(row, i), F.lit(0.0)))).alias("_e"),
        )
        next_ = state.join(moved, "g", "left")
        still = F.col("_size") < tol * F.greatest(F.lit(1.0), F.array_max(F.transform("_b", F.abs)))
        state = materialize(
            next_.select(
                "g", "n", "positives", "fitted", F.coalesce("_b", "beta").alias("beta"), F.coalesce("_e", "se").alias("se"), (F.col("done") | F.coalesce(still, F.lit(False))).alias("done")
            ),
            "logistic-state",
        )
    shown = state.select("g", "n", "positives", F.when(F.col("fitted"), F.col("beta")).alias("beta"), F.when(F.col("fitted"), F.col("se")).alias("se"), (F.col("fitted") & F.col("done")).alias("converged"), "fitted")
    return shown.select(*[F.col("g")[c].alias(c) for c in keys], "n", "positives", "beta", "se", "converged", "fitted")


def logistic(df: DataFrame, features: Sequence[str], y: str, *, key: str | None = None, **options) -> list[dict]:
    """The fits of :func:`fit_logistic` with odds ratios and limits, for one model or few keys: they are collected."""
    base = df.withColumn("key", F.col(key).cast("string") if key else F.lit("all"))
    out = []
    for r in fit_logistic(base, features, y, keys=["key"], **options).orderBy("key").collect():
        fit: dict = {"key": r["key"], "n": r["n"], "positives": r["positives"], "terms": [], "converged": r["converged"]}
        for name, b, se in zip(["intercept", *features], r["beta"] or [], r["se"] or []):
            fit["terms"].append({
                "feature": name, "coef": b, "se": se, "odds_ratio": math.exp(min(b, 700.0)),
                "ci_lower": math.exp(min(b - 1.959963984540054 * se, 700.0)), "ci_upper": math.exp(min(b + 1.959963984540054 * se, 700.0)),
                "p": math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else float("nan"),
            })
        out.append(fit)
    return out


def keyed_scores(df: DataFrame, fits: DataFrame, features: Sequence[str], keys: Sequence[str], *, out: str = "score") -> DataFrame:
    """Probability of class 1 by each key's own fit, joined by key; null for keys without a fit."""
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    joined = J.lookup(df, fits.select(*keys, F.col("beta").alias("_beta")), list(keys), "left")
    return joined.withColumn(out, 1 / (1 + F.exp(-LA.dot(x, F.col("_beta"))))).drop("_beta")


def logistic_scores(df: DataFrame, fits: Sequence[dict], *, key: str | None = None, out: str = "score") -> DataFrame:
    """Probability of class 1 by few collected fits; null for keys without a fit."""
    eta = F.lit(None).cast("double")
    for fit in fits:
        if not fit["terms"]:
            continue
        line = F.lit(0.0)
        for t in fit["terms"]:
            line = line + F.lit(t["coef"]) * (F.lit(1.0) if t["feature"] == "intercept" else F.col(t["feature"]).cast("double"))
        mine = F.col(key).cast("string") == fit["key"] if key else F.lit(True)
        eta = F.when(mine, line).otherwise(eta)
    return df.withColumn(out, 1 / (1 + F.exp(-eta)))


def fit_and_auc(df: DataFrame, features: Sequence[str], y: str, *, name: str = "model", **options) -> DataFrame:
    """One row: model, predictors, n, positives, AUC on the training rows."""
    fits = logistic(df, features, y, **options)
    auc = ST.roc_auc(logistic_scores(df, fits), "score", y)
    return auc.select(
        F.lit(name).alias("model"), F.lit(", ".join(features)).alias("predictors"),
        (F.col("positives") + F.col("negatives")).alias("n"), "positives", "auc",
    )


def grid_auc(cells: DataFrame, features: Sequence[str], *, fill: float = 6.0, y: str = "target", min_class: int = 3) -> DataFrame:
    """AUC per window size and horizon from one table of all cells, and whether the cell's fit converged.

    Cells with fewer than ``min_class`` rows of a class have no AUC.
    """
    keys = ["win", "horizon"]
    ready = materialize(cells.fillna({f: fill for f in features}), "cells")
    fits = fit_logistic(ready, features, y, keys=keys, min_class=min_class)
    auc = ST.roc_auc(keyed_scores(ready, fits, features, keys), "score", y, keys=keys).select(*keys, "auc")
    return fits.select(*keys, "n", "positives", "converged").join(auc, keys, "left")


# --- pyspark.ml models ---------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.fillna(0.0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def classifier(kind: str, *, seed: int = 42, c: float = 1.0, rows: int = 1, rounds: int = 100):
    """Estimator with the weight column: l1, forest, boost or svm (linear kernel; ``rbf`` is a :class:`KernelMachine`). The linear ones run until they converge."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "l1":
        return MC.LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * rows), standardization=False, maxIter=10_000, **common)
    if kind == "forest":
        return MC.RandomForestClassifier(numTrees=rounds, seed=seed, **common)
    if kind == "boost":
        return MC.GBTClassifier(maxIter=rounds, seed=seed, **common)
    if kind == "svm":
        return MC.LinearSVC(regParam=1.0 / (c * rows), maxIter=10_000, **common)
    raise ValueError(f"unknown classifier {kind!r}")


def fourier_weights(size: int, components: int, gamma: float, seed: int = 42) -> tuple[list[list[float]], list[float]]:
    """Random directions and phases whose cosines have the kernel exp(-gamma |x - y|^2) as mean product."""
    r = random.Random(seed)
    spread = math.sqrt(2 * gamma)
    return [[r.gauss(0, spread) for _ in range(size)] for _ in range(components)], [r.uniform(0, 2 * math.pi) for _ in range(components)]


def fourier_features(x: Column, weights: list[list[float]], phases: list[float]) -> Column:
    """``sqrt(2 / D) cos(w x + b)`` for each of D directions, of an array of features."""
    scale = math.sqrt(2.0 / len(phases))
    lines = F.array(*[F.struct(F.array(*[F.lit(v) for v in w]).alias("w"), F.lit(b).alias("b")) for w, b in zip(weights, phases)])
    return F.transform(lines, lambda line: F.lit(scale) * F.cos(LA.dot(line["w"], x) + line["b"]))


class KernelMachine:
    """A linear support-vector classifier on random Fourier features of standardised columns: the RBF kernel without a kernel matrix.

    The width follows the data as 1 / (number of features * variance), which for standardised columns is 1 / number of features.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], *, components: int = 256, gamma: float | None = None, seed: int = 42, c: float = 1.0, rows: int | None = None):
        self.features = list(features)
        filled = df.fillna(0.0, subset=self.features)
        m = filled.agg(*[f(x).alias(f"{n}_{x}") for x in self.features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
        self.scale = [(m[f"m_{x}"] or 0.0, m[f"s_{x}"] or 1.0) for x in self.features]
        self.weights, self.phases = fourier_weights(len(self.features), components, gamma or 1.0 / len(self.features), seed)
        ready = self._expand(filled)
        self.model = classifier("svm", c=c, rows=rows or ready.count()).fit(ready)

    def _expand(self, df: DataFrame) -> DataFrame:
        x = F.array(*[(F.col(c).cast("double") - mean) / sd for c, (mean, sd) in zip(self.features, self.scale)])
        return df.withColumn("features", array_to_vector(fourier_features(x, self.weights, self.phases)))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._expand(df.drop("features")))


def fit_classifier(kind: str, df: DataFrame, features: Sequence[str], y: str, **options):
    """Fit one of the :func:`classifier` kinds with balanced class weights.

    The training columns are written first: a fit runs hundreds of jobs over them, and each task of these would send the
    metrics of the whole plan behind them to the driver. Read back, tasks follow the bytes of these few columns.
    """
    weighted = class_weights(df.select(*features, F.col(y).cast("double").alias("label")), "label")
    weighted = materialize(weighted, "training")
    ready = assemble(weighted, features)
    if kind == "rbf":
        return KernelMachine(weighted, features, **options)
    if kind in ("l1", "svm"):
        options.setdefault("rows", ready.count())
    return classifier(kind, **options).fit(ready)


def classifier_scores(model, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of class 1, or the margin for models without probabilities."""
    scored = model.transform(assemble(df, features))
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.withColumn(out, vector_to_array(column)[1]).drop("features", "rawPrediction", "probability", "prediction")


def select_l1(df: DataFrame, features: Sequence[str], y: str, c: float = 0.1) -> list[str]:
    """Features with a non-zero L1 coefficient; all of them if there is none."""
    model = fit_classifier("l1", df, features, y, c=c)
    kept = [f for f, b in zip(features, model.coefficients.toArray()) if b != 0.0]
    return kept or list(features)


def select_f(df: DataFrame, features: Sequence[str], y: str, k: int = 10) -> list[str]:
    """The k features with the highest ANOVA F."""
    return [r["feature"] for r in ST.anova_f(df, features, y).limit(k).collect()]


def importances(model, features: Sequence[str], k: int = 15) -> list[tuple[str, float]]:
    ranked = sorted(zip(features, model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    return [(f, float(v)) for f, v in ranked[:k]]


def cross_validate(
    chunks: DataFrame,
    features: Sequence[str],
    *,
    y: str = "feedback_next",
    group: str = "event_id",
    k: int = 5,
    kind: str = "logistic",
    l1_c: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Grouped, stratified k-fold run: AUC, precision, recall, F1 at 0.5 and at the best train threshold.

    Folds without positives in the test part are skipped. Logistic fits of all folds are one keyed fit, and all their statistics one
    keyed job each; other models and a selection of features fit one fold after the other.
    """
    folded = materialize(W.group_folds(chunks.fillna(0.0, subset=list(features)), group=group, label=y, k=k, seed=seed), "folds")
    if kind == "logistic" and not l1_c:
        return _cross_validate_at_once(folded, features, y, k)
    usable = sorted(r["fold"] for r in folded.groupBy("fold").agg(F.max(y).alias("p")).where("p = 1").select("fold").collect())
    results = None
    for f in usable:
        train, test = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        train_s, test_s = ST.standardize(train, features, train), ST.standardize(test, features, train)
        chosen = select_l1(train_s, features, y, l1_c) if l1_c else list(features)
        if kind == "logistic":
            fits = logistic(train_s, chosen, y)
            score = lambda d: logistic_scores(d, fits)  # noqa: B023, E731
            converged = fits[0]["converged"]
        else:
            model = fit_classifier(kind, train_s, chosen, y)
            score = lambda d: classifier_scores(model, d, chosen)  # noqa: B023, E731
            converged = None
        tested = materialize(score(test_s).select("score", y), "tested")
        tuned = ST.best_threshold(score(train_s).select("score", y), "score", y).first()
        auc = ST.roc_auc(tested, "score", y).first()["auc"]
        for name, t in (("default", 0.5), ("tuned", tuned["threshold"] if tuned else 0.5)):
            row = ST.class_metrics(tested, "score", y, float(t)).select(
                F.lit(f + 1).alias("fold"), F.lit(name).alias("threshold"), F.lit(float(t)).alias("value"), F.lit(len(chosen)).alias("n_features"),
                F.lit(auc).alias("auc"), "precision", "recall", "f1", F.lit(converged).cast("boolean").alias("converged"),
            )
            results = row if results is None else results.unionByName(row)
    if results is None:
        raise ValueError("no fold has positives")
    return results


def _cross_validate_at_once(folded: DataFrame, features: Sequence[str], y: str, k: int) -> DataFrame:
    """All folds as keys of one fit: a row is a test row of its own fold's model and a training row of the others."""
    usable = folded.groupBy("fold").agg(F.max(y).alias("_p")).where("_p = 1").select(F.col("fold").alias("model"))
    rows = folded.select("fold", y, *features).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = J.lookup(rows.withColumn("_test", F.col("fold") == F.col("model")), usable, ["model"])
    train = lambda c: F.when(~F.col("_test"), F.col(c))
    spread = rows.groupBy("model").agg(*[f(train(c)).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.coalesce(f"_m_{c}", F.lit(0.0))) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in features}
    ready = materialize(J.lookup(rows, spread, ["model"]).withColumns(scaled).select("model", "_test", y, *features), "fold-rows")
    fits = materialize(fit_logistic(ready.where("not _test"), features, y, keys=["model"]), "fold-fits")
    scored = materialize(keyed_scores(ready, fits, features, ["model"]).select("model", "_test", y, "score"), "fold-scores")
    tested = scored.where("_test")
    auc = ST.roc_auc(tested, "score", y, keys=["model"]).select("model", "auc")
    tuned = ST.best_threshold(scored.where("not _test"), "score", y, keys=["model"]).select("model", F.col("threshold").alias("_t"))
    both = F.explode(F.array(F.struct(F.lit("default").alias("threshold"), F.lit(0.5).alias("value")), F.struct(F.lit("tuned").alias("threshold"), F.coalesce("_t", F.lit(0.5)).alias("value"))))
    levels = J.lookup(fits.select("model", "converged"), tuned, ["model"], "left").withColumn("_v", both).select("model", "converged", "_v.*")
    judged = tested.join(levels, "model")
    metrics = ST.class_metrics(judged, "score", y, F.col("value"), keys=["model", "threshold", "value", "converged"])
    return metrics.join(auc, "model", "left").select(
        (F.col("model") + 1).alias("fold"), "threshold", "value", F.lit(len(features)).alias("n_features"), "auc", "precision", "recall", "f1", "converged"
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and deviation of every metric per threshold."""
    long = folds.selectExpr("threshold", "stack(4, 'auc', auc, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, v)")
    return long.groupBy("metric", "threshold").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def partial_effect(df: DataFrame, fits: Sequence[dict], feature: str, others: Sequence[str], points: int = 300) -> DataFrame:
    """Predicted probability along one feature, the others at their median."""
    low_high = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = low_high.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * step)).alias(feature))
    for o in others:
        grid = grid.withColumn(o, F.lit(exact_quantiles(df, [], o, {"m": 0.5}).first()["m"]))
    return logistic_scores(grid, fits)
