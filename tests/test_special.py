"""Special functions against numerical integration and published quantiles."""

import math
import time

import pytest
from pyspark.sql import functions as F

from roadlens.functions import special as X


def _tail(t, n, steps=20000):
    """Two-sided p by Simpson's rule: the angle theta with t = sqrt(n) tan(theta) makes the density cos^(n - 1)."""
    scale = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)
    top = math.atan(t / math.sqrt(n))
    h = top / steps
    total = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(i * h) ** (n - 1) for i in range(steps + 1))
    return 1 - 2 * scale * total * h / 3


def test_erfc_and_log_gamma(spark):
    xs = [0.0, 1e-8, 0.3, 1.0, 2.4999, 2.5, 2.6, 4.0, 9.0, -0.7, -3.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.erfc(F.col("x")).alias("e")).collect():
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-12)
    gs = [0.5, 1.0, 2.5, 7.0, 100.25, 9999.5]
    for r in spark.createDataFrame([(x,) for x in gs], "x double").select("x", X.log_gamma(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-13)


def test_student_p(spark):
    rows = [(t, n) for n in (1, 2, 3, 5, 20, 200, 3000) for t in (0.0, 0.01, 0.5, 1.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "t double, n int")
    for r in df.select("t", "n", X.student_p(F.col("t"), F.col("n")).alias("p"), X.student_p(-F.col("t"), F.col("n")).alias("q")).collect():
        assert r["p"] == pytest.approx(_tail(r["t"], r["n"]), abs=1e-10) and r["p"] == r["q"]
    odd = spark.createDataFrame([(None, 5), (1.0, 0), (1e200, 5), (2.0, 10**9)], "t double, n int").select(X.student_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in odd][:2] == [None, None] and odd[2]["p"] == 0.0
    assert odd[3]["p"] == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-8)


def test_student_p_is_smooth_at_the_switch(spark):
    n = X.LARGE
    df = spark.createDataFrame([(t,) for t in (0.5, 1.96, 3.3, 6.0)], "t double")
    for r in df.select(X.student_p(F.col("t"), F.lit(n)).alias("a"), X.student_p(F.col("t"), F.lit(n + 1)).alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], rel=2e-4, abs=1e-9)


# Published two-sided 95 % quantiles of Student's t.
TABLE = {1: 12.706204736, 2: 4.30265273, 3: 3.182446305, 5: 2.570581836, 18: 2.10092204, 198: 1.972017478}


def test_student_quantile(spark):
    df = spark.createDataFrame([(n,) for n in TABLE], "n int").select("n", X.student_quantile(0.95, F.col("n")).alias("t"))
    for r in df.select("n", "t", X.student_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert r["t"] == pytest.approx(TABLE[r["n"]], abs=2e-9) and r["p"] == pytest.approx(0.05, abs=1e-12)
    big = spark.range(1).select(X.student_quantile(0.95, F.lit(10**8)).alias("t"), X.student_quantile(0.95, F.lit(0)).alias("z")).first()
    assert big["t"] == pytest.approx(1.959964, abs=1e-6) and big["z"] is None
    two = spark.range(1).select(X.student_quantile(0.95, F.lit(X.LARGE)).alias("a"), X.student_quantile(0.95, F.lit(X.LARGE + 1)).alias("b")).first()
    assert two["a"] == pytest.approx(two["b"], abs=1e-8)


def test_few_freedoms_take_few_terms(spark):
    """The terms of the fraction follow the freedom, and the p-values stay what all terms give."""
    def took(n):
        start = time.time()
        spark.range(0, 60_000, 1, 8).select(F.sum(X.student_p(F.col("id") / 9000.0, F.lit(n)))).collect()
        return time.time() - start

    took(8)
    assert took(8) < 0.6 * took(20_000)
    for n in (1, 2, 8, 150, 4000):
        got = spark.range(1).select(X.student_p(F.lit(1.7), F.lit(n)).alias("p")).first()["p"]
        assert got == pytest.approx(_tail(1.7, n), rel=1e-9)
