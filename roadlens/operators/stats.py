"""Statistics as aggregations and ordered scans.

Functions take ``keys`` and return one row (or one curve) per key, so many
groups are computed in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import special
from roadlens.functions.numeric import ratio
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators.quantiles import average_ranks


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(1)), ["_all"]


def _unkeyed(df: DataFrame) -> DataFrame:
    return df.drop("_all")


def score_counts(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """Positives and negatives per distinct score: what every ranking statistic needs."""
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def roc_auc(df: DataFrame, score: str, y: str, *, keys: Sequence[str] = (), chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Exact area under the ROC curve, ties count one half; null with one class only."""
    base, group = _keyed(df, keys)
    seq = S.sequence(score_counts(base, group, score, y), group, ["score"], chunk_bits)
    below = S.scan(seq, group, _below=S.running_sum("neg", inclusive=False))
    wins = F.col("pos") * (F.coalesce("_below", F.lit(0)) + F.col("neg") / 2)
    out = below.groupBy(*group).agg(F.sum(wins).alias("_w"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_w") / (F.col("positives") * F.col("negatives").cast("double")))
    return _unkeyed(out.withColumn("auc", auc).drop("_w"))


def mann_whitney(df: DataFrame, x: str, y: str, *, keys: Sequence[str] = (), chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Two-sided test of x between y = 0 and y = 1: normal approximation with tie and continuity correction."""
    base, group = _keyed(df, keys)
    counts = score_counts(base, group, x, y)
    ranks = average_ranks(counts.withColumn("n", F.col("pos") + F.col("neg")), group, "score", chunk_bits=chunk_bits, weight="n")
    joined = counts.join(ranks, [*group, "score"])
    t = F.col("ties").cast("double")
    g = joined.groupBy(*group).agg(
        F.sum(F.col("neg") * F.col("rank")).alias("_r0"),
        F.sum("neg").cast("double").alias("n0"),
        F.sum("pos").cast("double").alias("n1"),
        F.sum(t * t * t - t).alias("_tie"),
    )
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    u = F.col("_r0") - n0 * (n0 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * (n + 1 - ratio(F.col("_tie"), n * (n - 1))))
    z = ratio(F.greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5, sd)
    return _unkeyed(g.select(*group, "n0", "n1", u.alias("u"), z.alias("z"), F.least(F.lit(1.0), special.erfc(z / F.sqrt(F.lit(2.0)))).alias("p")))


def threshold_curve(df: DataFrame, score: str, y: str, *, keys: Sequence[str] = (), chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Precision, recall and F1 of "score >= threshold" at every distinct score."""
    base, group = _keyed(df, keys)
    seq = S.sequence(score_counts(base, group, score, y), group, ["score"], chunk_bits)
    run = S.scan(
        seq, group, _p=S.running_sum("pos", inclusive=False), _n=S.running_sum("neg", inclusive=False),
        _pp=S.total_sum("pos"), _nn=S.total_sum("neg"),
    )
    tp = F.col("_pp") - F.coalesce("_p", F.lit(0))
    fp = F.col("_nn") - F.coalesce("_n", F.lit(0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, F.col("_pp"))
    f1 = 2 * precision * recall / (precision + recall + 1e-9)
    return _unkeyed(run.select(*group, F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1")))


def best_threshold(df: DataFrame, score: str, y: str, *, keys: Sequence[str] = (), chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Threshold with the best F1; of equals the lowest."""
    curve, group = _keyed(threshold_curve(df, score, y, keys=keys, chunk_bits=chunk_bits), keys)
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("nt")))
    return _unkeyed(curve.groupBy(*group).agg(best.alias("b")).select(*group, (-F.col("b.nt")).alias("threshold"), F.col("b.f1").alias("f1")))


def class_metrics(df: DataFrame, score: str, y: str, threshold: Column | float, *, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of class 1 at a threshold; 0 where undefined."""
    base, group = _keyed(df, keys)
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    hit = F.col(score) >= t
    g = base.groupBy(*group).agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) != 1)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn")
    )
    tp = F.col("tp")
    share = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    out = g.withColumn("precision", share(tp, tp + F.col("fp"))).withColumn("recall", share(tp, tp + F.col("fn")))
    return _unkeyed(out.withColumn("f1", share(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows with both values; null where one side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, x: str, y: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation, its t score with n - 2 degrees of freedom, and the two-sided p-value of Student's t (0 for a perfect line)."""
    base, group = _keyed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    g = base.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), correlation(F.col(x), F.col(y)).alias("r"))
    open_ = 1 - F.col("r") * F.col("r")
    t = F.col("r") * F.sqrt(ratio(F.col("n") - 2, F.greatest(open_, F.lit(0.0))))
    p = F.when((open_ <= 0) & (F.col("n") > 2), F.lit(0.0)).otherwise(special.student_p(F.col("t"), F.col("n") - 2))
    return _unkeyed(g.withColumn("t", t).withColumn("p", p))


def corr_by_group(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of row-to-row steps of several column pairs; ``weakest`` is the smallest absolute value.

    ``df`` is sequenced by the keys.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    steps = S.scan(df, keys, **{f"_p_{c}": S.lag(c) for c in cols})
    step = lambda c: F.col(c) - F.col(f"_p_{c}")
    g = steps.groupBy(*keys).agg(*[correlation(step(a), step(b)).alias(f"corr_{a}_{b}") for a, b in pairs])
    return g.withColumn("weakest", F.least(*[F.abs(f"corr_{a}_{b}") for a, b in pairs]))


def ols(df: DataFrame, x: str, y: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x: slope, intercept, R2, MAE, RMSE and what a confidence band needs."""
    base, group = _keyed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    fit = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.avg(x).alias("x_mean"), F.regr_sxx(y, x).alias("ss_x"),
    )
    resid = F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    err = J.lookup(base, fit.select(*group, "slope", "intercept"), group).groupBy(*group).agg(
        F.avg(F.abs(resid)).alias("mae"), F.sqrt(F.avg(resid * resid)).alias("rmse")
    )
    return _unkeyed(fit.join(err, group))


def ols_band(fit: DataFrame, grid: DataFrame, x: str, level: float = 0.95) -> DataFrame:
    """Fitted line with its confidence band on a grid that carries the fit's keys; null limits with fewer than three rows."""
    keys = [c for c in grid.columns if c in fit.columns]
    parts = ("n", "slope", "intercept", "x_mean", "ss_x", "rmse")
    if keys:
        joined = grid.join(fit.select(*keys, *parts), keys)
    else:  # one fit: six numbers
        joined = grid.withColumns({c: F.lit(v) for c, v in fit.select(*parts).first().asDict().items()})
    line = F.col("intercept") + F.col("slope") * F.col(x)
    se = F.col("rmse") * F.sqrt(1 / F.col("n") + ratio(F.pow(F.col(x) - F.col("x_mean"), 2), F.col("ss_x")))
    # one quantile for each number of rows that occurs
    crit = joined.select("n").distinct().withColumn("_crit", special.student_quantile(level, F.col("n") - 2))
    half = F.col("_crit") * se
    joined = J.lookup(joined, crit, ["n"])
    return joined.select(*grid.columns, line.alias("fitted"), (line - half).alias("lower"), (line + half).alias("upper"))


def bin_rate(df: DataFrame, value: str, y: str, edges: Sequence[float], *, keys: Sequence[str] = ()) -> DataFrame:
    """n, hits and rate per right-closed bin; the lowest edge and values outside are left out."""
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        b = F.when((F.col(value) > edges[i]) & (F.col(value) <= edges[i + 1]), F.lit(i)).otherwise(b)
    binned = df.withColumn("bin", b).where("bin is not null and " + f"`{y}` is not null")
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits"), F.avg(y).alias("rate"))


def hazard(df: DataFrame, at: str, hit: str, min_rows: int = 5) -> DataFrame:
    """Share of hits among all rows of one time, for times with enough rows."""
    g = df.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit) == 1).alias("hits"))
    return g.where(F.col("n") >= min_rows).withColumn("rate", F.col("hits") / F.col("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and densities of equal-width bins; the last bin includes its upper edge."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    base, group = _keyed(inside.withColumn("bin", k), keys)
    counts = base.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*group).agg(F.sum("n").alias("_n"))
    return _unkeyed(counts.join(whole, group).withColumn("density", F.col("n") / (F.col("_n") * F.lit(width))).drop("_n"))


def density(df: DataFrame, value: str, low: float, high: float, points: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian density on an even grid, Scott bandwidth.

    Equal values are counted first. A value only meets the grid points within nine bandwidths; what lies
    further away adds less than the rounding of the sum. Sums per grid point are formed before the shuffle.
    """
    base, group = _keyed(df.where(F.col(value).isNotNull()), keys)
    counts = base.groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    stats = base.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"))
    sized = stats.select(*group, "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    step = (high - low) / (points - 1)
    grid = sized.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*group, "n", "_i")
    near = J.lookup(counts, sized.where("h > 0"), group)
    first = F.greatest(F.lit(0), F.ceil((F.col("v") - 9 * F.col("h") - F.lit(low)) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("v") + 9 * F.col("h") - F.lit(low)) / step)).cast("int")
    met = near.where(first <= last).withColumn("_i", F.explode(F.sequence(first, last)))
    z = (F.lit(low) + F.col("_i") * step - F.col("v")) / F.col("h")
    kernel = F.col("m") * F.exp(-z * z / 2) / (F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))
    sums = met.groupBy(*group, "_i").agg(F.sum(kernel).alias("_k"))
    spread = sized.select(*group, (F.col("h") > 0).alias("_fit"))
    out = grid.join(sums, [*group, "_i"], "left").join(spread, group)
    total = F.when(F.col("_fit"), F.coalesce("_k", F.lit(0.0)) / F.col("n"))
    return _unkeyed(out.select(*group, (F.lit(low) + F.col("_i") * step).alias("x"), total.alias("density")))


def standardize(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Subtract the mean and divide by the population deviation of the training rows."""
    source = df if train is None else train
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    m = source.agg(*aggs).first().asDict()
    scaled = {}
    for c in columns:
        mean, sd = m[f"m_{c}"] or 0.0, m[f"s_{c}"] or 0.0
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(sd if sd > 0 else 1.0)
    return df.withColumns(scaled)


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose deviation is not zero."""
    m = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if m[c]]


def anova_f(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One-way F of each feature between the classes of y, best first."""
    pairs = ", ".join(f"'{c}', double(`{c}`)" for c in features)
    long = df.selectExpr(f"`{y}` as y", f"stack({len(features)}, {pairs}) as (feature, v)").where("v is not null and y is not null")
    per = long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = per.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    both = per.join(grand, "feature").groupBy("feature", "total", "k").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("_b"), F.sum(F.col("n") * F.col("s")).alias("_w")
    )
    f = ratio(ratio(F.col("_b"), F.col("k") - 1), ratio(F.col("_w"), F.col("total") - F.col("k")))
    return both.select("feature", f.alias("f_value")).orderBy(F.desc("f_value"), "feature")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def pivot_metrics(df: DataFrame, index: str, column: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """First value per (index, column) as one column each."""
    return df.groupBy(index).pivot(column, list(columns) if columns else None).agg(F.first(value, ignorenulls=True))


def argmax_cell(grid: DataFrame, score: str, *cells: str) -> DataFrame:
    """The cell with the highest score; of equals the first in cell order."""
    best = F.max(F.struct(F.col(score), *[(-F.col(c)).alias(c) for c in cells]))
    return grid.where(F.col(score).isNotNull()).agg(best.alias("b")).select(*[(-F.col(f"b.{c}")).alias(c) for c in cells], F.col(f"b.{score}").alias(score))


def compare_models(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One-row model results under their names."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("model"), *df.columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no models given")
    return out
