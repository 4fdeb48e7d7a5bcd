"""Oversampling of the minority class between nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators import scan as S
from roadlens.operators.nearest import nearest_points
from roadlens.session import materialize


def smote(
    df: DataFrame, features: Sequence[str], y: str, *, k: int = 5, seed: int = 42, chunk_bits: int = S.CHUNK_BITS, ends: bool = False
) -> DataFrame:
    """Features and label with the minority class raised to the size of the other.

    New rows lie at a random place between a minority row and one of its k
    nearest minority rows. Every minority row gets its equal share of new rows;
    equal rows are neighbours of each other at distance 0. With ``ends`` the arrays ``start`` and ``end`` tell
    the two old rows of each new one (null for old rows).
    """
    base = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("int").alias(y))
    base = materialize(base.dropna(), "smote")
    old = base.withColumns({c: F.lit(None).cast("array<double>") for c in ("start", "end")}) if ends else base
    sizes = {r[y]: r["n"] for r in base.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) != 2 or sizes[0] == sizes[1]:
        return old
    rare = min(sizes, key=lambda c: sizes[c])
    need, have = max(sizes.values()) - sizes[rare], sizes[rare]
    few = base.where(F.col(y) == rare).select(F.array(*features).alias("x"))
    copies = few.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    near = materialize(nearest_points(few, len(features), k), "near")
    options = near.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("place", "neighbour"))).alias("_o"))  # at most k per point
    # spread copies to rows again, numbered over all tasks
    rows = copies.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    rows = S.scan(S.sequence(rows.withColumn("_all", F.lit(1)), ["_all"], [F.xxhash64("x", "_c", F.lit(seed)), "x", "_c"], chunk_bits), ["_all"], _i=S.running_count(F.lit(1), inclusive=False))
    share = F.lit(need // have) + F.when(F.col("_i") < need % have, 1).otherwise(0)
    made = rows.withColumn("_n", share.cast("int")).where("_n > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    made = made.join(options, "x", "left")

    def uniform(salt: int) -> Column:
        return F.pmod(F.xxhash64("x", "_c", "_j", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    # the own copies fill the first places of the k nearest
    twins = F.least(F.col("m") - 1, F.lit(k))
    others = F.coalesce(F.size("_o"), F.lit(0))
    known = F.least(F.lit(k), twins + others)
    pick = F.floor(uniform(1) * known)
    target = F.when(pick < twins, F.col("x")).otherwise(F.get("_o", (pick - twins).cast("int"))["neighbour"])
    gap = uniform(2)
    new = F.zip_with("start", "end", lambda a, b: a + gap * (b - a))
    fresh = made.withColumns({"start": F.col("x"), "end": F.coalesce(target, F.col("x"))}).withColumn("_x", new)
    fresh = fresh.select(*[F.get("_x", F.lit(i)).alias(f) for i, f in enumerate(features)], F.lit(rare).alias(y), "start", "end")
    return old.unionByName(fresh if ends else fresh.drop("start", "end"))
