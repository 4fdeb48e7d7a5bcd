"""Survival curves, tests, Cox models and concordance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import special
from roadlens.functions.numeric import ratio
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators.stats import _keyed, _unkeyed
from roadlens.session import materialize


def _time_counts(df: DataFrame, group: list[str], duration: str, event: str) -> DataFrame:
    rows = df.where(F.col(duration).isNotNull())
    return rows.groupBy(*group, F.col(duration).alias("time")).agg(
        F.count_if(F.col(event) == 1).alias("d"), F.count(F.lit(1)).alias("leaving")
    )


def kaplan_meier(
    df: DataFrame, duration: str, event: str, *, keys: Sequence[str] = (), z: float = 1.959963984540054, chunk_bits: int = S.CHUNK_BITS
) -> DataFrame:
    """Survival at every distinct time with its log-log confidence limits."""
    base, group = _keyed(df, keys)
    seq = S.sequence(_time_counts(base, group, duration, event), group, ["time"], chunk_bits)
    n = S.scan(seq, group, _gone=S.running_sum("leaving", inclusive=False), _all_n=S.total_sum("leaving"))
    n = n.withColumn("at_risk", F.col("_all_n") - F.coalesce("_gone", F.lit(0)))
    d, r = F.col("d"), F.col("at_risk")
    n = n.withColumn("_log", F.when(d < r, F.log1p(-d / r))).withColumn("_zero", F.when(d == r, 1)).withColumn(
        "_var", F.when(d < r, d / (r * (r - d)))
    )
    run = S.scan(n, group, _sum=S.running_sum("_log"), _dead=S.running_count("_zero"), _green=S.running_sum("_var"))
    s = F.when(F.col("_dead") > 0, F.lit(0.0)).otherwise(F.exp(F.coalesce("_sum", F.lit(0.0))))
    log_s = F.col("_sum")
    spread = ratio(z * F.sqrt("_green"), log_s)
    curve = F.log(-log_s)
    proper = (F.col("_dead") == 0) & (log_s < 0)
    out = run.select(
        *group, "time", "at_risk", "d", s.alias("survival"),
        F.when(proper, F.exp(-F.exp(curve - spread))).alias("lower"),
        F.when(proper, F.exp(-F.exp(curve + spread))).alias("upper"),
    )
    return _unkeyed(out)


def median_survival(curve: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """First time with survival of at most one half; null if it stays above."""
    base, group = _keyed(curve, keys)
    return _unkeyed(base.groupBy(*group).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median")))


def log_rank(df: DataFrame, duration: str, event: str, group: str, *, keys: Sequence[str] = (), chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Two-group log-rank test: observed and expected events of group 1, chi-square, p."""
    base, by = _keyed(df.where(F.col(duration).isNotNull()), keys)
    one = F.col(group) == 1
    times = base.groupBy(*by, F.col(duration).alias("time")).agg(
        F.count_if(F.col(event) == 1).alias("d"), F.count_if((F.col(event) == 1) & one).alias("d1"),
        F.count(F.lit(1)).alias("c"), F.count_if(one).alias("c1"),
    )
    seq = S.sequence(times, by, ["time"], chunk_bits)
    run = S.scan(
        seq, by, _b=S.running_sum("c", inclusive=False), _b1=S.running_sum("c1", inclusive=False), _n=S.total_sum("c"), _n1=S.total_sum("c1")
    )
    n = (F.col("_n") - F.coalesce("_b", F.lit(0))).cast("double")
    n1 = (F.col("_n1") - F.coalesce("_b1", F.lit(0))).cast("double")
    d = F.col("d").cast("double")
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1))
    g = run.groupBy(*by).agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(v).alias("variance"))
    chi2 = ratio(F.pow(F.col("observed") - F.col("expected"), 2), F.col("variance"))
    return _unkeyed(g.withColumn("chi2", chi2).withColumn("p", special.chi2_p(chi2)))


#: Bits of a digit of the score rank: a node keeps one running count for each of its 2 ** DIGIT_BITS digits.
DIGIT_BITS = 4


def concordance(
    df: DataFrame, duration: str, score: str, event: str, *, keys: Sequence[str] = (), chunk_bits: int = S.CHUNK_BITS
) -> DataFrame:
    """C-index: share of comparable pairs whose score order matches their duration order, ties one half.

    A pair is comparable if the shorter duration ended in an event (an equal
    duration counts if the other one is censored). Pairs are counted, never
    built: two ranks differ first at exactly one hexadecimal digit, so for every
    digit the rows sharing the higher digits form a node, and one ordered scan
    per node counts, for each row, the later rows of every digit. The work is n
    times the number of hexadecimal digits.
    """
    base, group = _keyed(df.where(F.col(duration).isNotNull() & F.col(score).isNotNull()), keys)
    # equal rows count together; an event comes before a censoring of its time
    rows = base.groupBy(*group, F.col(duration).alias("t"), F.col(score).alias("s"), (F.col(event) == 1).alias("e")).agg(
        F.count(F.lit(1)).alias("m")
    )
    rows = materialize(rows, "concordance")
    ranks = S.sequence(rows.select(*group, "s").distinct(), group, ["s"], chunk_bits)
    ranks = S.scan(ranks, group, r=S.running_count(F.lit(1), inclusive=False)).select(*group, "s", "r")
    ranked = rows.join(ranks, [*group, "s"])
    top = ranks.agg(F.max("r")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // DIGIT_BITS))
    # level -1: all rows in one node, under one digit
    level = F.explode(F.sequence(F.lit(-1), F.lit(levels - 1)))
    spread = ranked.select(*group, "t", "e", "m", "r", level.alias("b"))
    node = F.when(F.col("b") < 0, F.lit(0)).otherwise(F.expr(f"shiftright(r, {DIGIT_BITS} * (b + 1))"))
    digit = F.when(F.col("b") < 0, F.lit(0)).otherwise(F.expr(f"shiftright(r, {DIGIT_BITS} * b) & {(1 << DIGIT_BITS) - 1}")).cast("int")
    nodes = spread.select(*group, "t", "e", "m", "b", node.alias("node"), digit.alias("digit"))
    # rows of one node, instant and digit count together, so a crowded instant is a row a digit
    nodes = nodes.groupBy(*group, "b", "node", "t", "e", "digit").agg(F.sum("m").alias("m"))
    by = [*group, "b", "node"]
    # latest first; at one time the censored rows come before the events. Rows of the same time and kind are no partners:
    # by ascending digit, a row finds only lower digits of its own instant before it, and these are not asked for
    seq = S.sequence(nodes, by, [F.col("t").desc(), F.col("e").cast("int"), "digit"], chunk_bits)
    digits = range(1 << DIGIT_BITS)
    run = S.scan(seq, by, **{f"_later{j}": S.running_sum(F.when(F.col("digit") == j, F.col("m")), inclusive=False) for j in digits})
    later = [F.coalesce(f"_later{j}", F.lit(0)) for j in digits]
    higher = sum((F.when(F.col("digit") < j, later[j]).otherwise(0) for j in digits[1:]), F.lit(0))
    same = sum((F.when(F.col("digit") == j, later[j]).otherwise(0) for j in digits), F.lit(0))
    found = run.where("e").select(*group, "b", (F.col("m") * higher).cast("double").alias("_higher"), (F.col("m") * same).cast("double").alias("_same"))
    g = found.groupBy(*group).agg(
        F.sum(F.when(F.col("b") >= 0, F.col("_higher")).otherwise(0.0)).alias("concordant"),
        F.sum(F.when(F.col("b") == 0, F.col("_same")).otherwise(0.0)).alias("tied"),
        F.sum(F.when(F.col("b") == -1, F.col("_same")).otherwise(0.0)).alias("pairs"),
    )
    c = F.when(F.col("pairs") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("pairs"))
    return _unkeyed(g.withColumn("c_index", c))


# --- Cox models ---------------------------------------------------------------------------------


#: Ranks of tied deaths that one row sums.
TIED = 1024


def _cox_marks(long: DataFrame, chunk_bits: int) -> DataFrame:
    """The one sequence of a fit: a row for each end (+1) and each start (-1) of a risk interval, at its place in time.

    Places number the distinct times of a key, latest first, and carry the chunk for scans. Rows of one time share a place, so that
    a crowded time becomes one row wherever the sums are taken.
    """
    ends = F.array(
        F.struct(F.col("stop").alias("time"), F.lit(1).alias("sign"), F.col("event").alias("event")),
        F.struct(F.col("start").alias("time"), F.lit(-1).alias("sign"), F.lit(0).cast(long.schema["event"].dataType).alias("event")),
    )
    marks = long.select("g", "x", F.explode(ends).alias("_e")).select("g", "x", "_e.*")
    places = S.sequence(marks.select("g", "time").distinct(), ["g"], [F.col("time").desc()], chunk_bits)
    return materialize(J.lookup(marks, places, ["g", "time"]).drop("time"), "cox-sequence")


def _ranks(s0: Column, d0: Column, deaths: Column, low: Column) -> Column:
    """Efron's sums over the ranks ``l`` of one block of tied deaths, with a = l / deaths and u = 1 / (s0 - a d0):
    log u, u, a u, u^2, a u^2, a^2 u^2. Whatever the number of features, no other sums over ranks are needed."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("log", "u", "au", "uu", "auu", "aauu")])

    def add(acc: Column, l: Column) -> Column:
        a = l / deaths
        u = 1 / (s0 - a * d0)
        terms = {"log": F.log(u), "u": u, "au": a * u, "uu": u * u, "auu": a * u * u, "aauu": a * a * u * u}
        return F.struct(*[(acc[n] + v).alias(n) for n, v in terms.items()])

    return F.aggregate(F.sequence(low, F.least(deaths, low + TIED) - 1), zero, add)


def _cox_sums(marks: DataFrame, coefficients: DataFrame, k: int) -> DataFrame:
    """Log likelihood, gradient and negative Hessian per ``g`` of ``coefficients`` (``g, beta``), with Efron's ties.

    A risk set is a difference of running sums over time: rows whose stop is at or after the time minus rows whose start is. No
    row is paired with an event time, and the sequence is only read: each step aggregates it by place and scans the places.
    """
    eta = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    now = marks.join(F.broadcast(coefficients), "g").withColumn("eta", eta)  # one row a model
    x = [F.get("x", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.exp("eta")
    pieces = [w, *[w * v for v in x], *[w * x[i] * x[j] for i, j in pairs]]
    names = ["s", *[f"s{i}" for i in range(k)], *[f"s{i}_{j}" for i, j in pairs]]
    died = F.col("event") == 1
    of_deaths = lambda v: F.sum(F.when(died, v).otherwise(0.0))
    places = now.groupBy("g", S.CHUNK, S.SEQ).agg(
        *[F.sum(F.col("sign") * p).alias(n) for n, p in zip(names, pieces)],
        *[of_deaths(p).alias(f"d{n}") for n, p in zip(names, pieces)],
        F.count_if(died).alias("deaths"),
        of_deaths(F.col("eta")).alias("eta"),
        *[of_deaths(v).alias(f"x{i}") for i, v in enumerate(x)],
    )
    risk = S.scan(places, ["g"], **{n: S.running_sum(n) for n in names}).where("deaths > 0")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("deaths") - 1, F.lit(TIED).cast("long")))
    # blocks of one crowded time go to many tasks
    blocks = risk.withColumn("_low", low).repartition("g", S.SEQ, "_low")
    r = blocks.withColumn("_r", _ranks(F.col("s"), F.col("ds"), F.col("deaths"), F.col("_low")))
    u, au, uu, auu, aauu = (F.col(f"_r.{n}") for n in ("u", "au", "uu", "auu", "aauu"))
    once = lambda c: F.when(F.col("_low") == 0, F.col(c)).otherwise(0.0)
    aggs = [F.sum(once("eta") + F.col("_r.log")).alias("ll")]
    aggs += [F.sum(once(f"x{i}") - F.col(f"s{i}") * u + F.col(f"ds{i}") * au).alias(f"g{i}") for i in range(k)]
    for i, j in pairs:
        si, sj, di, dj = (F.col(c) for c in (f"s{i}", f"s{j}", f"ds{i}", f"ds{j}"))
        aggs.append(F.sum(F.col(f"s{i}_{j}") * u - F.col(f"ds{i}_{j}") * au - si * sj * uu + (si * dj + di * sj) * auu - di * dj * aauu).alias(f"h{i}_{j}"))
    return r.groupBy("g").agg(*aggs)


def cox_score(
    df: DataFrame, features: Sequence[str], beta: Sequence[float], *, start: str = "start_time", stop: str = "end_time", event: str = "event",
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """Log likelihood ``ll``, gradient ``g0 ...`` and information ``h0_0 ...`` at given coefficients of the unscaled features."""
    k = len(features)
    rows = _cox_rows(df, features, start, stop, event).select("start", "stop", "event", F.lit(0).alias("g"), F.array(*features).alias("x"))
    coefficients = df.sparkSession.createDataFrame([(0, [float(b) for b in beta])], "g int, beta array<double>")
    return _cox_sums(_cox_marks(rows, chunk_bits), coefficients, k).drop("g")


def cox(
    df: DataFrame,
    features: Sequence[str],
    *,
    start: str = "start_time",
    stop: str = "end_time",
    event: str = "event",
    penalizer: float = 0.0,
    l1_ratio: float = 0.0,
    max_iter: int = 25,
    tol: float = 1e-7,
    chunk_bits: int = S.CHUNK_BITS,
) -> list[dict]:
    """Time-varying Cox model: coefficient, hazard ratio, confidence limits and p per feature.

    Features are centred and scaled for the fit and the penalty (n times the
    elastic net) acts on the scaled ones. All Newton steps read one stored sequence, each is one distributed
    aggregation; only k and k x k numbers come to the driver.
    """
    data = _CoxData(df, [list(features)], start, stop, event, chunk_bits)
    return data.report(*data.newton(penalizer, l1_ratio, max_iter, tol))[0]


def cox_univariate(df: DataFrame, features: Sequence[str], **options) -> list[dict]:
    """One model per feature; all of them share every pass over the data."""
    args = dict(start="start_time", stop="end_time", event="event", penalizer=0.0, l1_ratio=0.0, max_iter=25, tol=1e-7, chunk_bits=S.CHUNK_BITS)
    args.update(options)
    data = _CoxData(df, [[f] for f in features], args["start"], args["stop"], args["event"], args["chunk_bits"])
    return [f[0] for f in data.report(*data.newton(args["penalizer"], args["l1_ratio"], args["max_iter"], args["tol"]))]


def cox_path(
    df: DataFrame, features: Sequence[str], penalizers: Sequence[float], *, l1_ratio: float = 1.0, start: str = "start_time", stop: str = "end_time",
    event: str = "event", max_iter: int = 25, tol: float = 1e-7, chunk_bits: int = S.CHUNK_BITS,
) -> list[tuple[float, list[dict]]]:
    """The fits of several penalties, largest first: each starts where the one before ended, and all read one sequence."""
    data = _CoxData(df, [list(features)], start, stop, event, chunk_bits)
    out, beta = [], None
    for penalizer in sorted(penalizers, reverse=True):
        beta, hess, live = data.newton(penalizer, l1_ratio, max_iter, tol, beta)
        out.append((penalizer, data.report(beta, hess, live)[0]))
    return out


def _cox_rows(df: DataFrame, features: Sequence[str], start: str, stop: str, event: str) -> DataFrame:
    rows = df.select(F.col(start).cast("double").alias("start"), F.col(stop).cast("double").alias("stop"), F.col(event).alias("event"),
                     *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    return rows.where("start < stop")


class _CoxData:
    """Scaled rows of several models over the same intervals, as one stored sequence."""

    def __init__(self, df: DataFrame, groups: list[list[str]], start: str, stop: str, event: str, chunk_bits: int):
        used = list(dict.fromkeys(f for g in groups for f in g))
        self.groups, self.k, self.spark = groups, max(len(g) for g in groups), df.sparkSession
        rows = materialize(_cox_rows(df, used, start, stop, event), "cox")
        aggs = [a for f in used for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
        norm = rows.agg(F.count(F.lit(1)).alias("n"), *aggs).first().asDict()
        self.n, self.scale = norm["n"], {f: norm[f"s_{f}"] or 1.0 for f in used}
        xs = lambda g: F.array(*[(F.col(f) - F.lit(norm[f"m_{f}"])) / F.lit(self.scale[f]) for f in g], *[F.lit(0.0)] * (self.k - len(g)))
        models = F.array(*[F.struct(F.lit(i).alias("g"), xs(g).alias("x")) for i, g in enumerate(groups)])
        long = rows.select("start", "stop", "event", F.explode(models).alias("z")).select("start", "stop", "event", "z.g", "z.x")
        self.marks = _cox_marks(long, chunk_bits)

    def newton(self, penalizer: float, l1_ratio: float, max_iter: int, tol: float, beta: list[np.ndarray] | None = None):
        """Coefficients of the scaled features, information matrices, and the models that have not converged."""
        beta = [np.zeros(len(g)) for g in self.groups] if beta is None else [b.copy() for b in beta]
        live, hess = set(range(len(self.groups))), {}
        l2, l1 = self.n * penalizer * (1 - l1_ratio), self.n * penalizer * l1_ratio
        for _ in range(max_iter):
            table = [(g, [float(b) for b in beta[g]] + [0.0] * (self.k - len(beta[g]))) for g in sorted(live)]
            coefficients = self.spark.createDataFrame(table, "g int, beta array<double>")
            for r in _cox_sums(self.marks, coefficients, self.k).collect():
                g = r["g"]
                m = len(self.groups[g])
                grad = np.array([r[f"g{i}"] for i in range(m)])
                hess[g] = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) + l2 * np.eye(m)
                if l1 > 0:
                    new = _soft_step(beta[g], grad - l2 * beta[g], hess[g], l1)
                else:
                    new = beta[g] + np.linalg.solve(hess[g] + 1e-12 * np.eye(m), grad - l2 * beta[g])
                if np.max(np.abs(new - beta[g])) < tol:
                    live.discard(g)
                beta[g] = new
            if not live:
                break
        return beta, hess, live

    def report(self, beta: list[np.ndarray], hess: dict[int, np.ndarray], live: set[int]) -> list[list[dict]]:
        out = []
        for i, g in enumerate(self.groups):
            cov = np.linalg.pinv(hess[i]) if i in hess else np.full((len(g), len(g)), np.nan)
            fit = []
            for j, f in enumerate(g):
                b, se = float(beta[i][j]) / self.scale[f], math.sqrt(max(cov[j, j], 0.0)) / self.scale[f]
                z = b / se if se > 0 else 0.0
                p = math.erfc(abs(z) / math.sqrt(2))
                lo, hi = b - 1.959963984540054 * se, b + 1.959963984540054 * se
                fit.append({"feature": f, "coef": b, "se": se, "hr": math.exp(b), "ci_lower": math.exp(lo), "ci_upper": math.exp(hi), "p": p, "significant": p < 0.05, "converged": i not in live})
            out.append(fit)
        return out


def _soft_step(beta: np.ndarray, grad: np.ndarray, h: np.ndarray, l1: float) -> np.ndarray:
    """Minimise the quadratic model plus the L1 term by coordinate steps (k numbers)."""
    target = h @ beta + grad
    b = beta.copy()
    for _ in range(100_000):
        old = b.copy()
        for i in range(len(b)):
            rest = target[i] - h[i] @ b + h[i, i] * b[i]
            b[i] = math.copysign(max(abs(rest) - l1, 0.0), rest) / h[i, i] if h[i, i] > 0 else 0.0
        if np.max(np.abs(b - old)) <= 1e-12 * max(1.0, np.max(np.abs(b))):
            return b
    raise ArithmeticError("the coordinate steps of the penalised model do not converge")


def log_hazard(df: DataFrame, fit: Sequence[dict], out: str = "log_hazard") -> DataFrame:
    """Linear predictor of a fitted model."""
    value = F.lit(0.0)
    for f in fit:
        value = value + F.coalesce(F.col(f["feature"]), F.lit(0.0)) * F.lit(f["coef"])
    return df.withColumn(out, value)


def cross_validated_concordance(
    df: DataFrame, features: Sequence[str], *, key: str = "event_id", fold: str = "fold", penalizer: float = 0.1,
    stop: str = "end_time", event: str = "event", **options,
) -> DataFrame:
    """C-index per held-out fold; folds without an event are skipped."""
    folds = sorted(r[fold] for r in df.groupBy(fold).agg(F.max(event).alias("e")).where("e = 1").select(fold).collect())
    scored = None
    for f in folds:
        fit = cox(df.where(F.col(fold) != f), features, stop=stop, event=event, penalizer=penalizer, **options)
        part = log_hazard(df.where(F.col(fold) == f), fit)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("no fold holds an event")
    per = scored.groupBy(fold, key).agg(F.max(stop).alias("duration"), F.max(event).alias("event"), (-F.avg("log_hazard")).alias("score"))
    return concordance(per, "duration", "score", "event", keys=[fold])
