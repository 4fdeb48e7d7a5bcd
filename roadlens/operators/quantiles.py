"""Exact quantiles and ranks without collecting a group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators import scan as S


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles of the non-null values.

    The built-in exact percentile keeps every distinct value of a group in one
    buffer. Here equal values are first counted, so that a value most rows have is one row; the distinct
    values are sorted across tasks, the rows below each are summed, and only the values at the wanted positions are kept.
    """
    keys = list(keys)
    group = keys or ["_all"]
    narrow = df.select(*keys, S.as_col(value).cast("double").alias("_v")).where("_v is not null")
    if not keys:
        narrow = narrow.withColumn("_all", F.lit(1))
    counts = narrow.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    seq = S.sequence(counts, group, ["_v"], chunk_bits)
    ranked = S.scan(seq, group, _below=S.running_sum("_c", inclusive=False), _n=S.total_sum("_c"))
    below = F.coalesce("_below", F.lit(0))
    aggs = []
    for name, q in probs.items():
        spot = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(spot), F.ceil(spot)
        at = lambda place: (place >= below) & (place < below + F.col("_c"))
        low = F.max(F.when(at(lo), F.col("_v")))
        high = F.max(F.when(at(hi), F.col("_v")))
        part = F.max(spot - lo)
        aggs.append((low + (high - low) * part).alias(name))
    out = ranked.groupBy(*group).agg(*aggs)
    return out if keys else out.drop("_all")


def average_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "rank",
    chunk_bits: int = S.CHUNK_BITS,
    weight: str | None = None,
) -> DataFrame:
    """Per key and distinct value: its count ``ties`` (or weight) and the average rank of those ties."""
    keys = list(keys)
    group = keys or ["_all"]
    base = df.where(F.col(value).isNotNull())
    if not keys:
        base = base.withColumn("_all", F.lit(1))
    counts = base.groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("ties"))
    seq = S.sequence(counts, group, [value], chunk_bits)
    below = S.scan(seq, group, _below=S.running_sum("ties", inclusive=False))
    ranked = below.select(
        *keys, value, "ties", (F.coalesce("_below", F.lit(0)) + (F.col("ties") + 1) / 2).alias(out)
    )
    return ranked
