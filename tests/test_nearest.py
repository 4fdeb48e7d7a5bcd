"""Nearest rows, quantiles and densities against plain computations, also for one hot key."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators import stats as ST
from roadlens.operators.quantiles import exact_quantiles


def brute(frames, targets, exclude, adjacent):
    out = {}
    for trip, name, t, *gone in targets:
        best = None
        for k, at, seq in frames:
            if k == trip and t is not None and at is not None and seq not in gone[:exclude]:
                earlier = at < t
                rank = (abs(at - t), not earlier, -seq if adjacent and earlier else seq)
                if best is None or rank < best[0]:
                    best = (rank, seq)
        if best:
            out[trip, name] = best[1]
    return out


@pytest.mark.parametrize("exclude,adjacent", [(0, False), (0, True), (1, False), (2, False)])
def test_nearest_row(spark, exclude, adjacent):
    rng = random.Random(10 * exclude + adjacent)
    frames = [(rng.choice("ab"), rng.choice([None, *range(12)])) for _ in range(60)] + [("c", 5)]
    seq = S.sequence(spark.createDataFrame([(k, None if t is None else float(t)) for k, t in frames], "trip string, at double"), ["trip"], ["at"])
    known = [(r["trip"], r["at"], r[S.SEQ]) for r in seq.collect()]
    numbers = [n for _, _, n in known]
    targets = [(rng.choice("abcd"), i, rng.choice([None, *(x / 2 for x in range(-4, 30))]), rng.choice(numbers), rng.choice(numbers)) for i in range(80)]
    table = spark.createDataFrame(targets, "trip string, name int, t double, x long, y long")
    got = J.nearest_row(seq, table, ["trip"], "at", "t", exclude=["x", "y"][:exclude], adjacent=adjacent, chunk_bits=3)
    assert {(r["trip"], r["name"]): r[S.SEQ] for r in got.collect()} == brute(known, targets, exclude, adjacent)


def test_nearest_row_of_a_long_trip(spark):
    frames = S.sequence(spark.range(100_000).select(F.lit("a").alias("trip"), (F.col("id") / 10).alias("at")), ["trip"], ["at"])
    targets = spark.range(20_000).select(F.lit("a").alias("trip"), (F.col("id") / 2 + 0.01).alias("t"))
    start = time.time()
    hits = J.nearest_row(frames, targets, ["trip"], "at", "t").join(frames, ["trip", S.SEQ])
    assert hits.where(F.abs(F.col("at") - F.col("t")) < 0.02).count() == 20_000
    assert time.time() - start < 90


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_with_one_common_value(spark, keys):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(4000) < 0.95, 0.0, rng.normal(size=4000))
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)] + [(0, None)], "k int, v double")
    probs = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.97, "e": 1.0}
    for r in exact_quantiles(df, keys, "v", probs, chunk_bits=4).collect():
        mine = values[np.arange(4000) % 3 == r["k"]] if keys else values
        assert [r[n] for n in probs] == pytest.approx(np.quantile(mine, list(probs.values())).tolist())


def test_density_with_an_outlier(spark):
    rng = np.random.default_rng(2)
    values = np.r_[rng.normal(50, 10, 2000), 3.7e4]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    h = values.std(ddof=1) * len(values) ** -0.2
    for r in ST.density(df, "v", 0.0, 100.0, 11).collect():
        want = sum(math.exp(-(((r["x"] - v) / h) ** 2) / 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, rel=1e-9)
