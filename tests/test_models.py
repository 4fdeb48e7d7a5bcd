"""Model fits and oversampling against small independent computations."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.catalog import models as CM
from roadlens.functions import linear as LA
from roadlens.operators import models as M
from roadlens.operators import nearest as NP
from roadlens.operators import smote as SM
from roadlens.operators import scan as S
from roadlens.operators import stats as ST
from roadlens.operators import survival as SV
from roadlens.operators import windows as W


def _logit_reference(x, y, w, penalty):
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (y - p)) - ridge @ beta
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, grad)
    return beta


def test_logistic_per_key(spark):
    r = random.Random(4)
    rows = [(g, r.gauss(0, 1), r.gauss(0, 1)) for g in ("a", "b") for _ in range(60)]
    rows = [(g, a, b, int(a + (b if g == "a" else -b) + r.gauss(0, 1) > 0.4)) for g, a, b in rows] + [("c", 1.0, 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    fits = {f["key"]: f for f in M.logistic(df, ["a", "b"], "y", key="g")}
    assert fits["c"]["terms"] == []
    for g in ("a", "b"):
        part = [q for q in rows if q[0] == g]
        x = np.array([[1, q[1], q[2]] for q in part])
        y = np.array([q[3] for q in part], dtype=float)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        want = _logit_reference(x, y, w, 1.0)
        assert [t["coef"] for t in fits[g]["terms"]] == pytest.approx(list(want), abs=1e-6)
    scored = M.logistic_scores(df, list(fits.values()), key="g")
    assert scored.where("g = 'c' and score is not null").count() == 0


def test_thousands_of_keys_in_one_fit(spark):
    r = np.random.default_rng(11)
    keys = np.repeat(np.arange(3000), 24)
    x = r.normal(size=(len(keys), 2))
    y = (x[:, 0] - x[:, 1] * (keys % 3) + r.normal(size=len(keys)) > 0).astype(int)
    df = spark.createDataFrame(list(zip(keys.tolist(), x[:, 0].tolist(), x[:, 1].tolist(), y.tolist())), "k long, a double, b double, y int")
    fits = M.fit_logistic(df, ["a", "b"], "y", keys=["k"], balanced=False)
    got = {f["k"]: f for f in fits.collect()}
    assert len(got) == 3000 and all(f["converged"] for f in got.values() if f["fitted"])
    # the plan reads a table: it does not grow with the keys
    assert len(fits._jdf.queryExecution().analyzed().toString()) < 5000
    for key in (0, 1, 2, 2999):
        part = keys == key
        design = np.c_[np.ones(part.sum()), x[part]]
        if not got[key]["fitted"]:
            continue
        want = _logit_reference(design, y[part].astype(float), np.ones(part.sum()), 1.0)
        assert got[key]["beta"] == pytest.approx(list(want), abs=1e-6)
        p = 1 / (1 + np.exp(-design @ want))
        cov = np.linalg.inv((design * (p * (1 - p))[:, None]).T @ design + np.diag([0.0, 1.0, 1.0]))
        assert got[key]["se"] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-5)


def test_solve(spark):
    r = np.random.default_rng(1)
    for k in (1, 2, 6):
        root = r.normal(size=(k, k))
        m, b = root @ root.T + 0.1 * np.eye(k), r.normal(size=k)
        df = spark.createDataFrame([(m.tolist(), b.tolist())], "m array<array<double>>, b array<double>")
        got = df.select(LA.solve(F.col("m"), F.col("b"), k).alias("s")).first()["s"]
        assert got["x"] == pytest.approx(np.linalg.solve(m, b).tolist(), rel=1e-8)
        assert np.allclose(got["inverse"], np.linalg.inv(m), rtol=1e-8)
    flat = spark.createDataFrame([([[4.0, 2.0, 0.0], [2.0, 1.0, 0.0], [0.0, 0.0, 0.0]], [2.0, 1.0, 0.0])], "m array<array<double>>, b array<double>")
    assert flat.select(LA.solve(F.col("m"), F.col("b"), 3).alias("s")).first()["s"]["x"] == pytest.approx([0.5, 0.0, 0.0])


def _cox_loglik(rows, beta):
    ll = 0.0
    for t in sorted({b for _, b, e, _ in rows if e}):
        dead = [x for _, b, e, x in rows if e and b == t]
        risk = sum(math.exp(x * beta) for a, b, _, x in rows if a < t <= b)
        tied = sum(math.exp(x * beta) for x in dead)
        ll += sum(x * beta for x in dead) - sum(math.log(risk - i / len(dead) * tied) for i in range(len(dead)))
    return ll


@pytest.mark.parametrize("bits", [1, 18])
def test_cox_maximises_the_efron_likelihood(spark, bits):
    r = random.Random(2)
    rows = []
    for i in range(40):
        a = r.randrange(0, 3)
        x = r.gauss(0, 1)
        rows.append((float(a), float(a + r.randrange(1, 6)), int(r.random() < 1 / (1 + math.exp(-x))), x))
    df = spark.createDataFrame(rows, "start_time double, end_time double, event int, x double")
    fit = SV.cox_univariate(df, ["x"], chunk_bits=bits)[0]
    best = max(np.linspace(fit["coef"] - 1, fit["coef"] + 1, 2001), key=lambda b: _cox_loglik(rows, b))
    assert fit["coef"] == pytest.approx(best, abs=2e-3)
    h = 1e-3
    curve = (_cox_loglik(rows, fit["coef"] + h) - 2 * _cox_loglik(rows, fit["coef"]) + _cox_loglik(rows, fit["coef"] - h)) / h**2
    assert fit["se"] == pytest.approx(1 / math.sqrt(-curve), rel=1e-3)
    lasso = SV.cox(df, ["x"], penalizer=50.0, l1_ratio=1.0)[0]
    assert lasso["coef"] == 0.0


def test_cox_score_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(SV, "TIED", 7)  # tied deaths in several blocks
    r = random.Random(4)
    rows = []
    for _ in range(300):
        a = r.randrange(0, 3)
        rows.append((float(a), float(r.choice([4, 4, 4, 5, 6])), int(r.random() < 0.6), r.gauss(0, 1)))
    df = spark.createDataFrame(rows, "start_time double, end_time double, event int, x double")
    for beta in (0.0, 0.7):
        got = SV.cox_score(df, ["x"], [beta], chunk_bits=1).first()
        h = 1e-4
        low, mid, high = (_cox_loglik(rows, beta + d) for d in (-h, 0, h))
        assert got["ll"] == pytest.approx(mid, rel=1e-10)
        assert got["g0"] == pytest.approx((high - low) / (2 * h), rel=1e-5, abs=1e-4)
        assert got["h0_0"] == pytest.approx(-(high - 2 * mid + low) / h**2, rel=1e-3)


def test_cox_path_shrinks_and_reads_one_sequence(spark, monkeypatch):
    r = random.Random(8)
    rows = [(0.0, float(1 + i % 9), int(r.random() < 0.5 + 0.3 * (x > 0)), x, r.gauss(0, 1)) for i in range(120) for x in [r.gauss(0, 1)]]
    df = spark.createDataFrame(rows, "start_time double, end_time double, event int, x double, z double")
    made, original = [], SV.S.sequence
    monkeypatch.setattr(SV.S, "sequence", lambda *a, **k: made.append(1) or original(*a, **k))
    path = SV.cox_path(df, ["x", "z"], [0.0, 0.02, 0.2])
    assert len(made) == 1
    assert [p for p, _ in path] == [0.2, 0.02, 0.0]
    size = [sum(abs(f["coef"]) for f in fit) for _, fit in path]
    assert size[0] <= size[1] <= size[2] and all(f["converged"] for _, fit in path for f in fit)
    plain = SV.cox(df, ["x", "z"])
    assert [f["coef"] for f in path[-1][1]] == pytest.approx([f["coef"] for f in plain], abs=1e-6)


@pytest.mark.parametrize("bits", [1, 18])
def test_concordance_counts_pairs(spark, bits):
    r = random.Random(8)
    rows = [(r.randrange(2), float(r.randrange(6)), float(r.randrange(5)), r.randrange(2)) for _ in range(60)]
    got = {
        x["g"]: (x["concordant"], x["tied"], x["pairs"])
        for x in SV.concordance(spark.createDataFrame(rows, "g long, t double, s double, e int"), "t", "s", "e", keys=["g"], chunk_bits=bits).collect()
    }
    for g in (0, 1):
        part = [q[1:] for q in rows if q[0] == g]
        good = tied = pairs = 0
        for ti, si, ei in part:
            for tj, sj, ej in part:
                if ei and (tj > ti or (tj == ti and not ej)):
                    pairs += 1
                    good += sj > si
                    tied += sj == si
        assert got[g] == (good, tied, pairs)


def test_survival_identities(spark):
    times = [1, 2, 2, 3, 5, 8, 8, 9]
    df = spark.createDataFrame([(float(t), 1, i % 2) for i, t in enumerate(times)], "t double, e int, g int")
    curve = {r["time"]: r["survival"] for r in SV.kaplan_meier(df, "t", "e", chunk_bits=1).collect()}
    for t in set(times):
        assert curve[t] == pytest.approx(1 - sum(x <= t for x in times) / len(times))
    assert SV.median_survival(SV.kaplan_meier(df, "t", "e")).first()["median"] == 3.0
    one = SV.log_rank(df, "t", "e", "g").first()
    two = SV.log_rank(df.withColumn("g", 1 - F.col("g")), "t", "e", "g").first()
    assert one["chi2"] == pytest.approx(two["chi2"])
    assert one["p"] == pytest.approx(math.erfc(math.sqrt(one["chi2"] / 2)), rel=1e-6)
    censored = df.withColumn("e", F.lit(0))
    assert {r["survival"] for r in SV.kaplan_meier(censored, "t", "e").collect()} == {1.0}


@pytest.mark.parametrize("bits", [2, 18])
def test_auc_and_rank_test(spark, bits):
    r = random.Random(1)
    rows = [(float(r.randrange(8)), int(r.random() < 0.4)) for _ in range(50)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    auc = ST.roc_auc(df, "s", "y", chunk_bits=bits).first()["auc"]
    assert auc == pytest.approx(wins / len(pos) / len(neg))
    mw = ST.mann_whitney(df, "s", "y", chunk_bits=bits).first()
    assert mw["u"] == pytest.approx(len(pos) * len(neg) - wins)
    assert mw["p"] == pytest.approx(min(1.0, math.erfc(mw["z"] / math.sqrt(2))), rel=1e-6)
    best = ST.best_threshold(df, "s", "y", chunk_bits=bits).first()

    def f1(t):
        tp = sum(s >= t for s in pos)
        p, q = tp / sum(s >= t for s, _ in rows), tp / len(pos)
        return 2 * p * q / (p + q + 1e-9)

    assert best["f1"] == pytest.approx(max(f1(t) for t in {s for s, _ in rows}))


def _neighbours(points, k):
    """Distances of the k nearest other distinct points."""
    x = np.unique(np.array(points), axis=0)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {tuple(p): np.sort(row)[: min(k, len(x) - 1)].tolist() for p, row in zip(x.tolist(), d)}


def _found(spark, points, dims, k, **options):
    got = {}
    for row in NP.nearest_points(spark.createDataFrame([(p,) for p in points], "x array<double>"), dims, k, **options).orderBy("place").collect():
        assert row["distance"] == pytest.approx(math.dist(row["x"], row["neighbour"]), rel=1e-12)
        got.setdefault(tuple(row["x"]), []).append((row["place"], row["distance"]))
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    return {x: [d for _, d in v] for x, v in got.items()}


@pytest.mark.parametrize("dims,leaf", [(1, 8), (2, 10), (12, 16), (12, 5000), (40, 30)])
def test_nearest_points_are_exact(spark, dims, leaf):
    r = np.random.default_rng(dims)
    middle = r.normal(size=(6, dims)) * 4
    pts = np.round(middle[r.integers(0, 6, 300)] + r.normal(size=(300, dims)), 3).tolist()
    pts += [[50.0] * dims, [1.0] * dims, [1.0] * dims] + [(np.ones(dims) * i / 7).tolist() for i in range(30)]  # an outlier, copies, ties
    got, want = _found(spark, pts, dims, 4, leaf_rows=leaf), _neighbours(pts, 4)
    assert set(got) == set(want)
    for x in want:
        assert got[x] == pytest.approx(want[x], rel=1e-12)


def test_nearest_points_of_few(spark):
    assert _found(spark, [[1.0, 2.0]], 2, 3) == {}
    pts = [[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]]
    assert _found(spark, pts, 2, 5, leaf_rows=1) == {(0.0, 0.0): [5.0, 10.0], (3.0, 4.0): [5.0, 5.0], (6.0, 8.0): [5.0, 10.0]}
    odd = spark.createDataFrame([(None,), ([1.0],), ([1.0, None],), ([1.0, float("nan")],)], "x array<double>")
    assert NP.nearest_points(odd, 2, 3).count() == 0


def test_nearest_points_grow_slowly(spark):
    """Four times the points take less than five times the time, in twelve dimensions."""
    took = []
    for n in (4000, 16000):
        df = spark.range(n).select(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.sin(F.xxhash64("id", i) / F.lit(2.0**40))).alias("x"))
        start = time.time()
        assert NP.nearest_points(df, 12, 5).count() == 5 * n
        took.append(time.time() - start)
    assert took[1] < 5 * took[0] + 5, took


def test_a_point_is_sent_to_a_block_once():
    x = np.random.default_rng(4).uniform(size=(3000, 12))
    pivots = x[:100]
    leaf = NP.distances(x, pivots).argmin(1)
    count, away = np.bincount(leaf, minlength=100), NP.distances(x, pivots).min(1)
    radius = np.array([away[leaf == i].max() for i in range(100)])
    block = NP.blocks_of(pivots, count, 500)
    assert np.bincount(block, weights=count).max() <= 500 and len(set(block)) <= 12
    order = np.argsort(block, kind="stable")
    tree = NP.Tree(pivots[order], count[order], radius[order], block[order])
    mine = x[leaf == order[0]]
    i, target = tree.asked(mine, 0, np.full(len(mine), np.inf))
    # every other block, not every leaf
    assert len(set(zip(i.tolist(), target.tolist()))) == len(i) == len(mine) * (len(set(block)) - 1)
    assert len(tree.asked(mine, 0, np.zeros(len(mine)))[0]) == 0


def test_points_without_end_take_no_part(spark):
    assert _found(spark, [[0.0, 0.0], [3.0, 4.0], [math.inf, 1.0], [1.0, -math.inf]], 2, 5) == {(0.0, 0.0): [5.0], (3.0, 4.0): [5.0]}


def test_smote_tells_the_ends_of_new_rows(spark):
    r = random.Random(8)
    rows = [(r.uniform(0, 1), r.uniform(0, 1), 0) for _ in range(40)] + [(r.uniform(5, 6), r.uniform(5, 6), 1) for _ in range(12)] + [(5.5, 5.5, 1)] * 3
    out = SM.smote(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", k=3, ends=True)
    made = out.where("start is not null").collect()
    assert len(made) == 25 and out.where("start is null").count() == 55 and all(m["y"] == 1 for m in made)
    few = {(a, b) for a, b, y in rows if y}
    near = _neighbours(list(few), 3)
    for m in made:
        (ax, ay), (bx, by) = m["start"], m["end"]
        assert (ax, ay) in few and (bx, by) in few and math.dist((ax, ay), (bx, by)) <= near[ax, ay][-1] + 1e-12
        assert abs((bx - ax) * (m["b"] - ay) - (by - ay) * (m["a"] - ax)) < 1e-12 and min(ax, bx) - 1e-12 <= m["a"] <= max(ax, bx) + 1e-12


def test_smote_balances_inside_the_minority(spark):
    r = random.Random(9)
    rows = [(r.uniform(0, 1), r.uniform(0, 1), 0) for _ in range(50)] + [(r.uniform(5, 6), r.uniform(5, 6), 1) for _ in range(10)] + [(5.5, 5.5, 1)] * 4
    out = SM.smote(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", k=3)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 50, 1: 50}
    assert out.where("y = 1 and (a < 5 or a > 6 or b < 5 or b > 6)").count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, SM.smote(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", k=3).collect()))


def test_group_folds(spark):
    rows = [(f"e{i // 3}", int(i // 3 % 4 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id string, y int")
    folded = W.group_folds(df, group="event_id", label="y", k=5, chunk_bits=2).collect()
    assert len(folded) == 90
    per = {}
    for r in folded:
        per.setdefault(r["event_id"], set()).add((r["fold"], r["y"]))
    assert all(len(v) == 1 for v in per.values())
    sizes = {}
    for v in per.values():
        sizes[next(iter(v))] = sizes.get(next(iter(v)), 0) + 1
    assert {sizes[(f, 1)] for f in range(5)} <= {1, 2} and {sizes[(f, 0)] for f in range(5)} <= {4, 5}
    train, test = W.split_groups(df, group="event_id", label="y")
    assert train.count() + test.count() == 90 and test.join(train, "event_id", "left_semi").count() == 0


def test_cross_validation_and_trees(spark):
    r = random.Random(3)
    rows = []
    for e in range(30):
        for w in range(4):
            a, b = r.gauss(0, 1), r.gauss(0, 1)
            rows.append((f"e{e}", w, a, b, 0.0, int(a > 0.3)))
    df = spark.createDataFrame(rows, "event_id string, window_index int, a double, b double, z double, feedback_next int")
    folds = M.cross_validate(df, ["a", "b", "z"], k=3)
    summary = {(r["metric"], r["threshold"]): r["mean"] for r in M.fold_summary(folds).collect()}
    assert summary[("auc", "default")] > 0.95
    assert M.select_l1(df, ["a", "b", "z"], "feedback_next", c=0.05) == ["a"]
    assert M.select_f(df.drop("z"), ["a", "b"], "feedback_next", k=1) == ["a"]
    assert ST.varying(df, ["a", "z"]) == ["a"]
    model = M.fit_classifier("boost", df, ["a", "b"], "feedback_next", rounds=3)
    assert M.importances(model, ["a", "b"])[0][0] == "a"
    for kind in ("forest", "svm"):
        fit = M.fit_classifier(kind, df, ["a", "b"], "feedback_next", **({"rounds": 10} if kind == "forest" else {}))
        assert ST.roc_auc(M.classifier_scores(fit, df, ["a", "b"]), "score", "feedback_next").first()["auc"] > 0.9
    effect = M.partial_effect(df, M.logistic(df, ["a", "b"], "feedback_next"), "a", ["b"], points=5).orderBy("a").collect()
    assert [e["score"] for e in effect] == sorted(e["score"] for e in effect)


def test_tasks_of_a_fit_follow_the_bytes(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(r.gauss(0, 1), i % 2) for i in range(640)], "a double, y int").repartition(64)
    sc = spark.sparkContext
    sc.setJobGroup("fit-tasks", "")
    try:
        M.fit_classifier("boost", df, ["a"], "y", rounds=3)
    finally:
        sc._jsc.clearJobGroup()
    tracker = sc.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("fit-tasks") for i in tracker.getJobInfo(j).stageIds}
    tasks = [tracker.getStageInfo(i).numTasks for i in stages if tracker.getStageInfo(i)]
    assert len(tasks) > 20 and sum(n >= 64 for n in tasks) <= 5


def test_concordance_counts_few_rows_a_pair_partner(spark, monkeypatch):
    r = random.Random(6)
    rows = [(r.choice("ab"), r.randint(0, 40), r.randint(0, 3000), r.randint(0, 1)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, t int, s int, e int")
    made, sequence = [], S.sequence
    monkeypatch.setattr(S, "sequence", lambda *a, **o: made.append(sequence(*a, **o)) or made[-1])
    got = {x["g"]: x for x in SV.concordance(df, "t", "s", "e", keys=["g"], chunk_bits=6).collect()}
    for g in "ab":
        mine = [x for x in rows if x[0] == g]
        pairs = [(a, b) for a in mine for b in mine if a[3] and (b[1] > a[1] or (b[1] == a[1] and not b[3]))]
        want = (sum(b[2] > a[2] for a, b in pairs), sum(b[2] == a[2] for a, b in pairs), len(pairs))
        assert (got[g]["concordant"], got[g]["tied"], got[g]["pairs"]) == want
    # ranks below 2 ** 9 have three hexadecimal digits, and all rows are one more node
    assert max(m.count() for m in made) <= 4 * len(rows)


def test_merged_windows_carry_no_idle_columns(spark, monkeypatch):
    seen, sequence = [], S.sequence
    monkeypatch.setattr(S, "sequence", lambda df, *a, **o: seen.append(df.columns) or sequence(df, *a, **o))
    merged = CM._merged(spark, "/root/testdata/sf0.001")
    assert set(CM._FEATURES) < set(merged.columns) and merged.count() > 0
    assert all(set(c) <= {"event_id", "window_index", "soon", *CM._FEATURES} for c in seen)


def test_constant_data_gives_nulls_and_no_error(spark):
    df = spark.createDataFrame([("k", float(i), 1.0, 0) for i in range(4)], "k string, x double, c double, y int")
    assert ST.pearson(df, "x", "c").first()["r"] is None
    assert ST.ols(df, "c", "x").first()["slope"] is None
    assert ST.roc_auc(df, "x", "y").first()["auc"] is None
    assert ST.mann_whitney(df, "x", "y").first()["z"] is None
    assert ST.best_threshold(df, "x", "y").first()["f1"] is None
    assert {r["f_value"] for r in ST.anova_f(df, ["x", "c"], "y").collect()} == {None}
    assert SV.log_rank(df, "x", "y", "y").first()["chi2"] is None
    assert {r["density"] for r in ST.density(df, "c", 0.0, 2.0, 3).collect()} == {None}
    assert ST.pearson(df.withColumn("z", 2 * F.col("x")), "x", "z").first()["r"] == pytest.approx(1.0)


def test_fourier_features_have_the_kernel(spark):
    weights, phases = M.fourier_weights(3, 2000, 0.4)
    points = np.random.default_rng(3).normal(size=(6, 3))
    df = spark.createDataFrame([(p.tolist(),) for p in points], "x array<double>")
    z = np.array([r["z"] for r in df.select(M.fourier_features(F.col("x"), weights, phases).alias("z")).collect()])
    exact = np.exp(-0.4 * ((points[:, None] - points[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 5 / math.sqrt(2000)


def test_rings_need_the_kernel(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        a, d = r.uniform(0, 2 * math.pi), r.gauss(1 if i % 2 else 3, 0.25)
        rows.append((d * math.cos(a), d * math.sin(a), i % 2))
    df = spark.createDataFrame(rows, "a double, b double, y int")
    area = {}
    for kind in ("svm", "rbf"):
        options = {"components": 64} if kind == "rbf" else {}
        model = M.fit_classifier(kind, df, ["a", "b"], "y", **options)
        area[kind] = ST.roc_auc(M.classifier_scores(model, df, ["a", "b"]), "score", "y").first()["auc"]
    assert area["rbf"] > 0.95 > 0.8 > area["svm"]
