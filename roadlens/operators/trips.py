"""Per-trip sequence operators built on the chunked scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators.quantiles import exact_quantiles


def fill_states(
    frames: DataFrame, keys: Sequence[str], state: str, previous: str, *, trigger: str = "yellow", out: str = "state"
) -> DataFrame:
    """Forward-filled state; rows before the first known state take that row's
    ``previous`` value if the first state is ``trigger`` (any case)."""
    head = F.when(F.col(state).isNotNull(), F.struct(F.col(state).alias("s"), F.col(previous).alias("p")))
    got = S.scan(frames, keys, _filled=S.last_known(state), _head=S.first_of_all(head))
    before = F.when(F.lower(F.trim(F.col("_head.s"))) == trigger.lower(), F.col("_head.p"))
    return got.withColumn(out, F.coalesce("_filled", before)).drop("_filled", "_head")


def rolling_difference(
    frames: DataFrame, keys: Sequence[str], value: str, *, rows: int, out: str, block_rows: int = 1 << S.CHUNK_BITS
) -> DataFrame:
    """Sum of the last ``rows`` row-to-row differences, null until all of them exist."""

    def build(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return {out: F.when(F.count("_step").over(frame) == rows, F.sum("_step").over(frame))}

    steps = S.scan(frames, keys, _prev=S.lag(value)).withColumn("_step", F.col(value) - F.col("_prev"))
    return S.neighbours(steps, keys, rows - 1, 0, build, block_rows).drop("_prev", "_step")


def first_decline(
    frames: DataFrame, keys: Sequence[str], at: str, value: str, *, rows: int, threshold: float, out: str
) -> DataFrame:
    """Per key the first time the rolling difference is at or below ``threshold``."""
    rolled = rolling_difference(frames, keys, value, rows=rows, out="_sum")
    first = F.min_by(at, S.SEQ).alias(out)
    return rolled.where(F.col("_sum") <= threshold).groupBy(*keys).agg(first)


def cumulative_distance(frames: DataFrame, keys: Sequence[str], at: str, speed: str, *, out: str) -> DataFrame:
    """Running sum of speed times time step; the first step is 0, null speeds add nothing."""
    steps = S.scan(frames, keys, _prev=S.lag(at))
    step = F.coalesce(F.col(at) - F.col("_prev"), F.lit(0.0))
    summed = S.scan(steps.withColumn("_part", F.col(speed) * step), keys, _sum=S.running_sum("_part"))
    # a row without a speed has no distance of its own
    return summed.withColumn(out, F.when(F.col(speed).isNotNull(), F.col("_sum"))).drop("_prev", "_part", "_sum")


def sustained_stop(
    frames: DataFrame,
    keys: Sequence[str],
    at: str,
    speed: str,
    *,
    threshold: float = 0.3,
    min_duration: float = 1.0,
    default_step: float = 0.1,
    out: str = "stop_time",
) -> DataFrame:
    """Per key the start of the first slow run that lasts long enough.

    Long enough is ``min_duration`` over the key's median time step, in rows.
    Runs are islands, so the run length may differ from key to key.
    """
    keys = list(keys)
    slow = F.coalesce(F.col(speed) <= threshold, F.lit(False))
    marked = S.scan(frames.withColumn("_slow", slow), keys, _pt=S.lag(at), _ps=S.lag("_slow"))
    steps = exact_quantiles(
        marked.where(F.col("_pt").isNotNull()), keys, F.col(at) - F.col("_pt"), {"_m": 0.5}
    )
    starts = marked.withColumn("_start", F.when(~F.coalesce("_ps", F.lit(False)) & F.col("_slow"), F.col(S.SEQ)))
    runs = (
        S.scan(starts, keys, _run=S.last_known("_start"))
        .where("_slow")
        .groupBy(*keys, "_run")
        .agg(F.count(F.lit(1)).alias("_len"), F.min(at).alias("_t"))
    )
    step = F.when(F.col("_m") > 0, F.col("_m")).otherwise(default_step)
    need = F.greatest(F.lit(1.0), F.rint(F.lit(float(min_duration)) / step))
    long_runs = runs.join(steps, keys, "left").where(F.col("_len") >= need)
    return long_runs.groupBy(*keys).agg(F.min("_t").alias(out))


def sign_latch(frames: DataFrame, keys: Sequence[str], signed: Column, *, valid: Column, out: str) -> DataFrame:
    """True on valid rows before ``signed`` first shows the sign opposite to its first non-zero one."""
    sign = F.when(F.coalesce(valid, F.lit(False)), F.signum(signed))
    marked = frames.withColumn("_sign", sign)
    based = S.scan(marked, keys, _base=S.first_of_all(F.when(F.col("_sign") != 0, F.col("_sign"))))
    flipped = F.when(F.col("_sign") == -F.col("_base"), 1)
    latched = S.scan(based.withColumn("_flip", flipped), keys, _gone=S.running_count("_flip"))
    open_ = F.col("_sign").isNotNull() & (F.col("_gone") == 0)
    return latched.withColumn(out, open_).drop("_sign", "_base", "_flip", "_gone")


def truncate_after_first(frames: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Rows up to and including the first hit of each key."""
    seen = S.scan(frames, keys, _hits=S.running_count(F.when(hit, 1), inclusive=False))
    return seen.where(F.col("_hits") == 0).drop("_hits")


def relative_time(frames: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """Time since the earliest row of the key.

    A pre-aggregated minimum joined back: no window holds a whole trip.
    """
    start = frames.groupBy(*keys).agg(F.min(at).alias("_t0"))
    return J.lookup(frames, start, list(keys), "left").withColumn(out, F.col(at) - F.col("_t0")).drop("_t0")


def monotone_violations(
    frames: DataFrame, keys: Sequence[str], value: str, *, tolerance: float = 0.0, out: str = "violations"
) -> DataFrame:
    """Per key the number of steps below ``tolerance``."""
    steps = S.scan(frames, keys, _prev=S.lag(value))
    bad = F.col(value) - F.col("_prev") < tolerance
    return steps.groupBy(*keys).agg(F.count_if(bad).alias(out))


def first_flag(frames: DataFrame, keys: Sequence[str], hit: Column, *, out: str) -> DataFrame:
    """1 on the first hit of a group, 0 on its other rows, null in groups without a hit."""
    first = frames.where(hit).groupBy(*keys).agg(F.min(S.SEQ).alias("_first"))
    joined = J.lookup(frames, first, list(keys), "left")
    return joined.withColumn(out, (F.col(S.SEQ) == F.col("_first")).cast("int")).drop("_first")


def flag_nearest(
    frames: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    at: str,
    target_at: str,
    *,
    out: str,
    adjacent: bool = False,
) -> DataFrame:
    """1 on every frame that is the closest one to some target time, else 0."""
    hits = J.nearest_row(frames, targets.select(*keys, target_at), keys, at, target_at, adjacent=adjacent)
    marked = hits.select(*keys, S.SEQ).distinct().withColumn("_hit", F.lit(1))
    joined = frames.join(marked, [*keys, S.SEQ], "left")
    return joined.withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")
