"""Event windows: features, targets, imputation, segments, event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.numeric import ratio, round_even
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators import trips as TR
from roadlens.operators.quantiles import exact_quantiles

# Fixed values of the data set.
FIXED_FILLS = {
    "TrafficLight_prev": "Green",
    "TrafficLight_current": "Green",
    "Speed_mean": 0,
    "Speed_max": 0,
    "Speed_std": 0,
    "Speed_delta": 0,
    "is_stopped": 1,
    "Brake_max": 0,
    "Braking_rate": 0,
    "delta_distance": 0,
    "yellow_transition": 0,
    "transition_phase": 0,
    "max_time_since_event_start": 0,
    "Accelerating_rate": 0,
}
MEDIAN_FILLS = ("Acceleration_max", "Acceleration_min", "SteeringAngle_absmax", "SteeringAngle_std")
MEAN_FILLS = ("min_distance_from_relevant_object",)
TTC_FILL = 999.0
TTC_CEILING = 6.0
STOPPED_BELOW = 0.5
PARTIAL_SLACK = 0.05
FEEDBACK = "first_feedback_relavet_to_event"
META = ("Id", "Condition", "Map", "event_category")


def place_in_windows(frames: DataFrame, keys: Sequence[str], at: str, size: float) -> DataFrame:
    """Add ``window_index``, ``start_time``, ``end_time`` and ``is_partial_window``.

    Windows tumble from each key's own first row. A row exactly at the key's end
    on a window edge belongs to no window; empty windows keep their index.
    """
    span = frames.groupBy(*keys).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1"))
    placed = J.lookup(frames.where(F.col(at).isNotNull()), span, list(keys))
    k = F.floor((F.col(at) - F.col("_t0")) / size).cast("long")
    begin = F.col("_t0") + F.col("window_index") * F.lit(float(size))
    return (
        placed.withColumn("window_index", k)
        .withColumn("_begin", begin)
        .where(F.col("_begin") < F.col("_t1"))
        .withColumn("start_time", round_even(F.col("_begin"), 4))
        .withColumn("end_time", round_even(F.least(F.col("_begin") + size, F.col("_t1")), 4))
        .withColumn("is_partial_window", (F.col("_begin") + size > F.col("_t1") + PARTIAL_SLACK).cast("int"))
        .drop("_t0", "_t1", "_begin")
    )


def rate(pred: Column) -> Column:
    """Share of rows where the predicate holds; null counts as no."""
    return F.avg(F.coalesce(pred, F.lit(False)).cast("int"))


def window_features(
    frames: DataFrame, *, size: float = 1.0, key: str = "event_id", at: str = "time_since_event_start_world", order: str = S.SEQ
) -> DataFrame:
    """One row per event and window with the 26 features.

    Positional first/last values keep nulls; distance and time-to-collision
    deltas use the first and last non-null value. The mean speed is summed in
    the order of ``order``, whatever the partitioning, so that a mean on a limit
    falls on the same side in every run; a window's speeds are held for that.
    """
    placed = place_in_windows(frames, [key], at, size)
    o = [F.col(at).alias("t"), F.col(order).alias("o")]
    edge = F.struct(*o, "Speed", "TrafficLight", "TrafficLight_JunctionPhase", *META)
    d = F.col("distance_from_relevant_object")
    ttc = F.when(F.abs("time_to_collision") < float("inf"), F.col("time_to_collision"))
    seen = lambda c: F.when(c.isNotNull(), F.struct(*o, c.alias("v")))
    g = placed.groupBy(key, "window_index", "start_time", "end_time", "is_partial_window").agg(
        F.min(edge).alias("_a"),
        F.max(edge).alias("_z"),
        F.max(at).alias("max_time_since_event_start"),
        F.mode("relevant_object_name", True).alias("relevant_object_name"),
        F.min(d).alias("min_distance_from_relevant_object"),
        F.min(seen(d)).alias("_d0"),
        F.max(seen(d)).alias("_d1"),
        F.count(d).alias("_dn"),
        F.max("Brake").alias("Brake_max"),
        rate(F.col("Brake") > 0).alias("Braking_rate"),
        F.max("Acceleration").alias("Acceleration_max"),
        F.min("Acceleration").alias("Acceleration_min"),
        rate(F.col("Acceleration") > 0).alias("Accelerating_rate"),
        F.array_sort(F.collect_list(F.when(F.col("Speed").isNotNull(), F.struct(F.col(order).alias("o"), F.col("Speed").cast("double").alias("v"))))).alias("_v"),
        F.max("Speed").alias("Speed_max"),
        F.stddev_samp("Speed").alias("Speed_std"),
        F.max(F.abs("SteeringAngle")).alias("SteeringAngle_absmax"),
        F.stddev_samp("SteeringAngle").alias("SteeringAngle_std"),
        F.min(ttc).alias("TTC_min"),
        F.avg(ttc).alias("TTC_mean"),
        F.min(seen(ttc)).alias("_c0"),
        F.max(seen(ttc)).alias("_c1"),
        F.count(ttc).alias("_cn"),
        F.bool_or(F.col("TrafficLight") == "Yellow").alias("_yellow"),
    )
    g = g.withColumn("Speed_mean", ratio(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x["v"]), F.size("_v")))
    light0, phase0, phase1 = F.col("_a.TrafficLight"), F.col("_a.TrafficLight_JunctionPhase"), F.col("_z.TrafficLight_JunctionPhase")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return g.select(
        *[F.col(f"_a.{m}").alias(m) for m in META],
        key,
        "window_index",
        "is_partial_window",
        "start_time",
        "end_time",
        F.lit(float(size)).alias("window_size_sec"),
        "max_time_since_event_start",
        "relevant_object_name",
        "min_distance_from_relevant_object",
        F.when(F.col("_dn") >= 2, round_even(F.col("_d0.v") - F.col("_d1.v"), 4)).alias("delta_distance"),
        "Brake_max",
        "Braking_rate",
        "Acceleration_max",
        "Acceleration_min",
        "Accelerating_rate",
        "Speed_mean",
        "Speed_max",
        "Speed_std",
        round_even(F.col("_z.Speed") - F.col("_a.Speed"), 4).alias("Speed_delta"),
        flag(F.col("Speed_mean") < STOPPED_BELOW).alias("is_stopped"),
        "SteeringAngle_absmax",
        "SteeringAngle_std",
        "TTC_min",
        "TTC_mean",
        F.when(F.col("_cn") >= 2, round_even(F.col("_c1.v") - F.col("_c0.v"), 4)).alias("TTC_delta"),
        light0.alias("TrafficLight_prev"),
        F.col("_z.TrafficLight").alias("TrafficLight_current"),
        flag(F.col("_yellow") & ~light0.eqNullSafe(F.lit("Yellow"))).alias("yellow_transition"),
        phase0.alias("prev_phase"),
        phase1.alias("current_phase"),
        # two unknown phases count as a change
        (~phase0.eqNullSafe(phase1) | (phase0.isNull() & phase1.isNull())).cast("int").alias("transition_phase"),
    )


def window_targets(
    windows: DataFrame, feedback: DataFrame, *, key: str = "event_id", out: str = FEEDBACK, horizon: float = 1.0
) -> DataFrame:
    """Feedback inside the window and within ``horizon`` after it; windows after the hit are dropped.

    ``feedback`` has the key and ``feedback_at``.
    """
    f = F.col("feedback_at")
    inside = F.coalesce((F.col("start_time") <= f) & (f <= F.col("end_time")), F.lit(False))
    soon = F.coalesce((f > F.col("end_time")) & (f <= F.col("end_time") + horizon), F.lit(False))
    first = feedback.groupBy(key).agg(F.min("feedback_at").alias("feedback_at"))
    timed = J.lookup(windows, first, [key], "left").withColumn(out, inside.cast("int")).withColumn(
        "feedback_next_1s", soon.cast("int")
    )
    hit = timed.where(F.col(out) == 1).groupBy(key).agg(F.min("window_index").alias("_hit"))
    return (
        J.lookup(timed, hit, [key], "left")
        .where(F.col("_hit").isNull() | (F.col("window_index") <= F.col("_hit")))
        .drop("_hit", "feedback_at")
    )


def impute(
    windows: DataFrame,
    *,
    fixed: Mapping[str, object] = FIXED_FILLS,
    medians: Sequence[str] = MEDIAN_FILLS,
    means: Sequence[str] = MEAN_FILLS,
    ttc_fill: float | None = None,
    object_col: str = "relevant_object_name",
) -> DataFrame:
    """Drop windows without an object and fill the gaps.

    Unknown phases become Approaching in partial windows, else LeavingJunction.
    Medians and means are taken after the rows were dropped. TTC columns stay
    null unless ``ttc_fill`` is given.
    """
    kept = windows.where(F.col(object_col).isNotNull())
    # a handful of numbers; the values themselves are never collected
    fills = dict(fixed)
    if means:
        fills.update({k: v for k, v in kept.agg(*[F.avg(c).alias(c) for c in means]).first().asDict().items() if v is not None})
    for c in medians:
        middle = exact_quantiles(kept, [], c, {"m": 0.5}).first()
        if middle is not None and middle["m"] is not None:
            fills[c] = middle["m"]
    if ttc_fill is not None:
        fills.update({c: ttc_fill for c in ("TTC_min", "TTC_mean", "TTC_delta")})
    unknown = F.when(F.col("is_partial_window") == 1, "Approaching").otherwise("LeavingJunction")
    out = kept
    for c in ("prev_phase", "current_phase"):
        if c in kept.columns:
            out = out.withColumn(c, F.coalesce(c, unknown))
    return out.fillna({c: v for c, v in fills.items() if c in kept.columns})


def null_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Null counts per column before and after cleaning."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
        return one.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, {name})")

    return counts(before, "nulls_before").join(counts(after, "nulls_after"), "column_name", "left")


def short_events(windows: DataFrame, *, key: str = "event_id", hit: str = "feedback_next_1s") -> DataFrame:
    """Row count and feedback of each event, with the too-short mark."""
    found = F.coalesce(F.bool_or(F.col(hit) == 1), F.lit(False))
    summary = windows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), found.cast("int").alias("ends_with_feedback"))
    few = F.when(F.col("ends_with_feedback") == 1, F.col("n_rows") < 2).otherwise(F.col("n_rows") < 3)
    return summary.withColumn("too_short", few)


def drop_short_events(windows: DataFrame, *, key: str = "event_id", hit: str = "feedback_next_1s") -> DataFrame:
    bad = short_events(windows, key=key, hit=hit).where("too_short").select(key)
    return windows.join(bad, key, "left_anti")


# aggregate of each column over n consecutive windows: fixed values
N_ROW_AGGREGATES = {
    "min_distance_from_relevant_object": "min",
    "Brake_max": "max",
    "Braking_rate": "max",
    "Acceleration_max": "max",
    "Acceleration_min": "min",
    "Accelerating_rate": "max",
    "Speed_mean": "mean",
    "Speed_max": "max",
    "Speed_std": "mean",
    "is_stopped": "max",
    "SteeringAngle_absmax": "max",
    "SteeringAngle_std": "mean",
    "TTC_min": "min",
    "TTC_mean": "mean",
    "yellow_transition": "max",
    "transition_phase": "max",
}
N_ROW_DELTAS = {
    "delta_distance": "min_distance_from_relevant_object",
    "Speed_delta": "Speed_mean",
    "TTC_delta": "TTC_mean",
}
N_ROW_FIRST = ("Id", "Condition", "Map", "event_category", "relevant_object_name", "start_time")
N_ROW_LAST = (
    "end_time", "max_time_since_event_start", "TrafficLight_prev", "TrafficLight_current", "prev_phase", "current_phase",
)


def n_row_windows(
    windows: DataFrame,
    *,
    n: int,
    horizon: int,
    key: str = "event_id",
    order: str = "window_index",
    target: str = "feedback_next_1s",
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """Merge every ``n`` consecutive windows of an event; incomplete rests are dropped.

    ``feedback_next`` tells whether any of the ``horizon`` windows after the
    merged ones has the target.
    """
    have = set(windows.columns)
    seq = S.sequence(windows, [key], [order], chunk_bits)
    hit = (F.col(target) == 1).cast("int")
    ahead = S.neighbours(seq, [key], 0, horizon, lambda w: {"_ahead": F.max(hit).over(w.rowsBetween(1, horizon))})
    placed = S.scan(ahead, [key], _pos=S.running_count(F.lit(1), inclusive=False)).withColumn(
        "_k", F.floor(F.col("_pos") / n).cast("long")
    )
    fold = {"min": F.min, "max": F.max, "mean": F.avg}
    cols = [c for c in dict.fromkeys([*N_ROW_FIRST, *N_ROW_LAST, *N_ROW_DELTAS.values(), "_ahead"]) if c in have or c == "_ahead"]
    edge = F.struct("_pos", *cols)
    g = placed.groupBy(key, "_k").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(edge).alias("_a"),
        F.max(edge).alias("_z"),
        *[fold[f](c).alias(c) for c, f in N_ROW_AGGREGATES.items() if c in have],
    ).where(F.col("_n") == n)
    return g.select(
        key,
        *[F.col(f"_a.{c}").alias(c) for c in N_ROW_FIRST if c in have],
        *[F.col(f"_z.{c}").alias(c) for c in N_ROW_LAST if c in have],
        F.col("_k").alias("window_index"),
        F.lit(n).alias("window_size_sec"),
        *[c for c in N_ROW_AGGREGATES if c in have],
        *[(F.col(f"_z.{c}") - F.col(f"_a.{c}")).alias(d) for d, c in N_ROW_DELTAS.items() if c in have],
        F.coalesce("_z._ahead", F.lit(0)).alias("feedback_next"),
    )


def horizon_windows(
    windows: DataFrame,
    *,
    sizes: Sequence[int],
    horizons: Sequence[int],
    keys: Sequence[str] = ("event_id",),
    at: str = "start_time",
    features: Mapping[str, tuple[str, str]],
    hit: str = FEEDBACK,
) -> DataFrame:
    """Windows of every size with targets for every horizon, all cells in one pass.

    ``features`` maps an output to (column, "mean" or "min"). A window [t, t+w)
    counts while t+w is at most the last start + 1; its target looks at
    [t+w, t+w+h). Only hit rows are expanded over horizons.
    """
    keys = list(keys)
    span = windows.groupBy(*keys).agg(F.min(at).alias("_t0"), (F.max(at) + 1).alias("_t1"))
    rows = J.lookup(windows, span, keys).withColumn("win", F.explode(F.array(*[F.lit(int(w)) for w in sizes])))
    since = F.col(at) - F.col("_t0")
    k = F.floor(since / F.col("win")).cast("long")
    placed = rows.withColumn("_k", k).where(F.col("_t0") + (F.col("_k") + 1) * F.col("win") <= F.col("_t1"))
    fold = {"min": F.min, "mean": F.avg}
    cells = placed.groupBy(*keys, "win", "_k").agg(*[fold[f](c).alias(name) for name, (c, f) in features.items()])
    cells = cells.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    hits = rows.where(F.col(hit) == 1).withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    # windows whose horizon [t0+(k+1)w, t0+(k+1)w+h) holds the hit
    last = F.floor(since / F.col("win")).cast("long") - 1
    first = F.floor((since - F.col("horizon")) / F.col("win")).cast("long")
    reached = (
        hits.where(first <= last)
        .select(*keys, "win", "horizon", F.explode(F.sequence(first, last)).alias("_k"))
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    out = cells.join(reached, [*keys, "win", "horizon", "_k"], "left")
    return out.withColumn("target", F.coalesce("_hit", F.lit(0))).drop("_hit").withColumnRenamed("_k", "window_no")


def assign_segments(
    windows: DataFrame,
    *,
    key: str = "event_id",
    at: str = "start_time",
    out: str = "segment",
) -> DataFrame:
    """Segment 1 (before yellow), 2 (decision) or 3 (junction) of each window.

    Rows at the stop line stay null. After entering on green, segment 2 ends
    with the last red window; otherwise with the first stop inside the junction.
    """
    t = F.col(at)
    phase, light = F.col("current_phase"), F.col("TrafficLight_current")
    near, junction = phase == "Approaching", phase.isin("InsideJunction", "LeavingJunction")
    entered = F.when(phase == "InsideJunction", F.struct(t.alias("t"), light.alias("light")))
    one = windows.groupBy(key).agg(F.min(F.when(F.col("yellow_transition") == 1, t)).alias("_y"), F.min(entered).alias("_in"))
    first = J.lookup(windows, one, [key])
    two = first.groupBy(key, "_y", "_in").agg(
        F.max(F.when((t >= F.col("_y")) & (light == "Red"), t)).alias("_red"),
        F.min(F.when((t >= F.col("_in.t")) & junction & (F.col("is_stopped") == 1), t)).alias("_stop"),
    )
    y, stop = F.col("_y"), F.col("_stop")
    moving = near | junction
    green = F.coalesce(F.col("_in.light") == "Green", F.lit(False))
    red = F.coalesce(F.col("_red"), y)
    seg = (
        F.when(y.isNull(), F.when(near, 1).when(junction, 3))
        .when(F.col("_in").isNull(), F.when(near & (t < y), 1).when(near, 2))
        .when(green, F.when(near & (t < y), 1).when((t >= y) & (t <= red), F.when(near, 2)).when((t > red) & moving, 3))
        .when(
            stop.isNotNull(),
            F.when((t > stop) & moving, 3).when((t >= y) & moving, 2).when(near & (t < y), 1),
        )
        .otherwise(F.when((t >= y) & moving, 2).when(near & (t < y), 1))
    )
    return J.lookup(windows, two, [key]).withColumn(out, seg).drop("_y", "_in", "_red", "_stop")


def segment_times(windows: DataFrame, *, key: str = "event_id", at: str = "start_time", ttc: str = "TTC_min") -> DataFrame:
    """Imputed TTC in segments 1 and 2 and times from the event's and the segment's start."""
    filled = F.least(F.coalesce(F.col(ttc), F.lit(TTC_FILL)), F.lit(TTC_CEILING))
    early = windows.withColumn("TTC_imputed", F.when(F.col("segment").isin(1, 2), filled))
    timed = TR.relative_time(early, [key], at, "time_from_event_start")
    start = timed.where("segment is not null").groupBy(key, "segment").agg(F.min(at).alias("_s"))
    return J.lookup(timed, start, [key, "segment"], "left").withColumn("time_from_seg_start", F.col(at) - F.col("_s")).drop("_s")


def first_nonnull(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Per column its first non-null value, which may come from different rows."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def event_table(windows: DataFrame, *, key: str = "event_id", hit: str = FEEDBACK) -> DataFrame:
    """One row per event with a yellow transition: TTC at yellow, feedback, delay between them."""
    yellow = windows.where("yellow_transition = 1")
    at_yellow = first_nonnull(yellow, [key], ["TTC_min", "start_time"], "start_time").toDF(key, "TTC_min_at_yellow", "yellow_start_time")
    inside = windows.join(yellow.select(key).distinct(), key, "left_semi")
    meta = first_nonnull(inside, [key], ["Id", "Condition", "Map"], "start_time")
    told = F.when(F.col(hit) == 1, F.struct(F.col("start_time").alias("t"), F.col("TrafficLight_current").alias("light")))
    spoken = inside.groupBy(key).agg(F.min(told).alias("_f"))
    return meta.join(at_yellow, key).join(spoken, key).select(
        key, "Id", "Condition", "Map", "TTC_min_at_yellow", "yellow_start_time",
        F.col("_f").isNotNull().cast("int").alias(hit),
        F.col("_f.t").alias("feedback_time"),
        F.col("_f.light").alias("TrafficLight_at_feedback"),
        (F.col("_f.t") - F.col("yellow_start_time")).alias("time_to_feedback"),
    )


def cap_at_quantile(df: DataFrame, column: str, q: float, out: str, rows: DataFrame | None = None) -> DataFrame:
    """Clip a column at its own exact quantile (taken over ``rows`` if given)."""
    top = exact_quantiles(df if rows is None else rows, [], column, {"q": q}).first()
    if top is None or top["q"] is None:
        return df.withColumn(out, F.col(column))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.least(F.col(column), F.lit(top["q"]))))


def flag_outliers(df: DataFrame, column: str, *, factor: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """True above Q3 + factor * IQR."""
    q = exact_quantiles(df, [], column, {"q1": 0.25, "q3": 0.75}).first()
    if q is None:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, F.col(column) > q["q3"] + factor * (q["q3"] - q["q1"]))


def survival_rows(windows: DataFrame, *, key: str = "event_id", order: str = "window_index", hit: str = "feedback_next_1s", cap: float = 20.0) -> DataFrame:
    """Windows up to the first hit, ``event`` = 1 there; capped and logged TTC."""
    first = windows.where(F.col(hit) == 1).groupBy(key).agg(F.min(order).alias("_first"))
    kept = J.lookup(windows, first, [key], "left").where(F.col("_first").isNull() | (F.col(order) <= F.col("_first")))
    capped = F.when(F.col("TTC_min").isNotNull(), F.least(F.col("TTC_min"), F.lit(cap)))
    event = F.coalesce(F.col(order) == F.col("_first"), F.lit(False)).cast("int")
    return kept.withColumn("event", event).withColumn("TTC_capped", capped).withColumn("TTC_log", F.log1p(capped)).drop("_first")


def event_durations(
    windows: DataFrame, *, keys: Sequence[str] = ("event_id",), at: str, order: str = "start_time", hit: str = FEEDBACK,
    level: str | None = None, censored: str = "max",
) -> DataFrame:
    """Duration to the first feedback, else to the end (``censored`` = max or min of ``at``).

    With ``level`` the mean of that column is added and split at its median.
    """
    keys = list(keys)
    told = F.when(F.col(hit) == 1, F.struct(F.col(order).alias("o"), F.col(at).alias("v")))
    aggs = [F.min(told).alias("_f"), (F.max(at) if censored == "max" else F.min(at)).alias("_c")]
    if level:
        aggs.append(F.avg(level).alias("level"))
    g = windows.groupBy(*keys).agg(*aggs)
    out = g.select(
        *keys, F.when(F.col("_f").isNotNull(), F.col("_f.v")).otherwise(F.col("_c")).alias("duration"),
        F.col("_f").isNotNull().cast("int").alias("event"), *(["level"] if level else []),
    )
    if level:
        middle = exact_quantiles(out, [], "level", {"m": 0.5}).first()
        cut = middle["m"] if middle is not None else None
        out = out.withColumn("grp", F.coalesce(F.col("level") >= F.lit(cut), F.lit(False)).cast("int"))
    return out


def entry_light_split(windows: DataFrame, *, key: str = "event_id", at: str = "start_time") -> DataFrame:
    """Events by the light at the first window inside the junction: Green or Yellow/Red."""
    inside = windows.where("current_phase = 'InsideJunction'")
    light = first_nonnull(inside, [key], ["TrafficLight_current"], at)
    events = windows.select(key).distinct()
    entry = F.when(F.col("TrafficLight_current") == "Green", "Green").otherwise("Yellow/Red")
    return events.join(light, key, "left").select(key, entry.alias("entry_light"))


def one_hot(df: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for the given training values; unseen values give zeros."""
    new = {
        f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int") for c, vals in columns.items() for v in vals
    }
    return df.select("*", *[e.alias(n) for n, e in new.items()]).drop(*columns)


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct values of each categorical column (label sets, not data)."""
    pairs = reduce(
        DataFrame.unionByName, [df.select(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")).distinct() for c in columns]
    )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in pairs.where("v is not null").orderBy("c", "v").collect():
        found[r["c"]].append(r["v"])
    return found


def group_folds(
    df: DataFrame, *, group: str, label: str, k: int = 5, seed: int = 42, out: str = "fold", chunk_bits: int = S.CHUNK_BITS
) -> DataFrame:
    """Fold number per group, stratified by the group's label; whole groups stay together.

    Groups are dealt out in hash order within their stratum, so folds differ by
    at most one group per stratum.
    """
    groups = df.groupBy(group).agg(F.max(label).alias("_stratum"))
    mixed = groups.withColumn("_h", F.xxhash64(F.col(group), F.lit(seed)))
    seq = S.sequence(mixed, ["_stratum"], ["_h", group], chunk_bits)
    placed = S.scan(seq, ["_stratum"], _pos=S.running_count(F.lit(1), inclusive=False))
    return J.lookup(df, placed.select(group, (F.col("_pos") % k).cast("int").alias(out)), [group])


def split_groups(df: DataFrame, *, group: str, label: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Stratified train/test split by whole groups."""
    k = round(1 / test_share)
    folded = group_folds(df, group=group, label=label, k=k, seed=seed, out="_fold")
    return folded.where("_fold <> 0").drop("_fold"), folded.where("_fold = 0").drop("_fold")
