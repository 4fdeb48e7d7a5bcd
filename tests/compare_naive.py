"""Wall time of the temporal operators next to plain plans: ``python tests/compare_naive.py [sf_dir] [hot_rows]``.

The plain plans join on the trip and filter, or put a whole trip into one window.
"""

import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roadlens import catalog  # noqa: E402
from roadlens.operators import scan as S  # noqa: E402
from roadlens.sources import shipped as D  # noqa: E402


def naive_asof(spark, sf):
    f = D.frames(spark, sf)
    right = f.where(F.col("label").isin("view", "click")).select("trip", F.col("t").alias("rt"), F.col("ord").alias("tord"), "value")
    left = f.where(~F.col("label").isin("view", "click")).select("trip", "t", "ord")
    w = Window.partitionBy("trip", "ord").orderBy(F.abs(F.col("t") - F.col("rt")), "rt")
    return left.join(right, "trip", "left").withColumn("_r", F.row_number().over(w)).where("_r = 1")


def naive_fill(spark, sf):
    f = D.ordered_frames(spark, sf, "label")
    s = D.error_spans(f).toDF("trip2", "a", "b", "rank")
    j = f.join(s, F.expr("trip = trip2 and t > a and t < b"), "left")
    return j.groupBy("trip", "ord", "label").agg(F.max("rank").alias("rank"))


def naive_nearest(spark, sf):
    f = D.frames(spark, sf).select("trip", "t", "ord")
    marks = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("trip"), (D.days("o_orderdate", "1996-01-01") * 900).alias("x")).distinct()
    best = marks.join(f, "trip").groupBy("trip", "x").agg(F.min(F.struct(F.abs(F.col("t") - F.col("x")), "t", "ord")).alias("b"))
    hits = best.select("trip", F.col("b.ord").alias("ord")).distinct().withColumn("flag", F.lit(1))
    return f.join(hits, ["trip", "ord"], "left")


def run(df):
    start = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    hot = int(sys.argv[2]) if len(sys.argv) > 2 else 20_000_000
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.load()
    out = {}
    for name, plain in (("asof_nearest", naive_asof), ("interval_fill", naive_fill), ("nearest_frame_flag", naive_nearest)):
        run(lambda: catalog.QUERIES[name](spark, sf))  # noqa: B023
        out[name] = (run(lambda: catalog.QUERIES[name](spark, sf)), run(lambda: plain(spark, sf)))  # noqa: B023
    # one trip holds all rows: running sum over the whole trip
    rows = spark.range(0, hot, numPartitions=8).select(F.lit(1).alias("k"), F.xxhash64("id").alias("t"), F.rand(1).alias("v"))
    rows.write.mode("overwrite").parquet("/tmp/spark-hot-trip")
    one = spark.read.parquet("/tmp/spark-hot-trip")
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out["hot_trip_running_sum"] = (
        run(lambda: S.scan(S.sequence(one, ["k"], ["t"]), ["k"], total=S.running_sum("v"))),
        run(lambda: one.withColumn("total", F.sum("v").over(w))),
    )
    print(json.dumps({k: {"ours": a, "plain": b} for k, (a, b) in out.items()}))


if __name__ == "__main__":
    main()
