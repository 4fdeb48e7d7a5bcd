"""Event propagation over the frames of a trip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators.quantiles import exact_quantiles
from roadlens.session import materialize

TRIP = ("Id", "Condition", "Map")


def flag_intervals(
    frames: DataFrame,
    intervals: DataFrame,
    labels: Sequence[str],
    *,
    keys: Sequence[str] = TRIP,
    row_id: Sequence[str],
    at: str = "SimulationTime",
    start: str = "start",
    end: str = "end",
    label: str = "label",
) -> DataFrame:
    """One 0/1 column per label: is the frame inside a (closed) interval of it?"""
    narrow = frames.select(*keys, *row_id, at).distinct()
    marks = intervals.where(F.col(label).isin(*labels)).select(*keys, start, end, label)
    hits = (
        J.interval_join(narrow, marks, keys, at, start, end)
        .groupBy(*keys, *row_id)
        .agg(*[F.max((F.col(label) == x).cast("int")).alias(x) for x in labels])
    )
    out = frames.drop(*labels).join(hits, [*keys, *row_id], "left")
    return out.select(*[c for c in frames.columns if c not in labels], *[F.coalesce(x, F.lit(0)).alias(x) for x in labels])


def attach_point_events(
    frames: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str] = ("Id", "Condition"),
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
    extra: Sequence[str] = ("Reason",),
) -> DataFrame:
    """Left join on the tenth of a second; frames without an event get ``None``.

    Frame times are rounded to the tenth. Several events at one key copy the frame.
    """
    marks = events.select(*keys, N.decisecond(F.col(at)).alias("_ds"), label, *extra)
    rounded = frames.drop(label, *extra).withColumn(at, N.round_decisecond(F.col(at)))
    joined = rounded.withColumn("_ds", N.decisecond(F.col(at))).join(marks, [*keys, "_ds"], "left")
    return joined.drop("_ds").withColumn(label, F.coalesce(label, F.lit(T.NO_EVENT)))


def synthesize_missing_starts(
    events: DataFrame,
    *,
    trip: str = "Id",
    group: Sequence[str] = ("Condition",),
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
    sigmas: float = 3.0,
) -> DataFrame:
    """Append a start event for every light a trip passes without one.

    Its time is the trip's StartPoint plus the median delay the *other* trips of
    the same group needed to their start of that light, delays above mean +
    ``sigmas`` standard deviations left out. Fewer than two delays give no bound
    and therefore no event. The parsed light number is compared.
    """
    group = list(group)
    parsed = events.withColumn("_tl", T.light_number(F.col(label))).withColumn(
        "_is_start", T.light_event_kind(F.col(label)) == "start"
    )
    origin = (
        parsed.where(F.col(label) == "StartPoint")
        .groupBy(trip, *group)
        .agg(F.min(at).alias("_origin"))
    )
    lights = parsed.where("_tl is not null").groupBy(trip, *group, "_tl").agg(
        F.bool_or("_is_start").alias("_has")
    )
    delays = (
        parsed.where("_is_start")
        .join(origin, [trip, *group])
        .select(*group, "_tl", (F.col(at) - F.col("_origin")).alias("_delay"))
    )
    # a trip that lacks the start has no delay of its own here, so the pool of a
    # light never has to exclude the trip it is used for
    bound = delays.groupBy(*group, "_tl").agg(
        (F.avg("_delay") + sigmas * F.stddev_samp("_delay")).alias("_bound")
    )
    usual = delays.join(bound, [*group, "_tl"]).where(F.col("_delay") <= F.col("_bound"))
    medians = exact_quantiles(usual, [*group, "_tl"], "_delay", {"_median": 0.5})
    made = (
        lights.where(~F.col("_has"))
        .join(origin, [trip, *group])
        .join(medians, [*group, "_tl"])
        .select(
            trip,
            *group,
            (F.col("_origin") + F.col("_median")).alias(at),
            F.concat(F.lit("Start traffic light "), F.col("_tl").cast("string")).alias(label),
        )
    )
    return events.unionByName(made, allowMissingColumns=True)


def event_pairs(
    frames: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
    base: str = "BaseEvent",
) -> DataFrame:
    """First start and first end of every base event, as ``_from``/``_to`` times.

    Without a start row the first plain row of the event counts as its start.
    ``_rank`` orders the pairs: real starts in frame order, then the fallbacks.
    """
    lab = F.lower(F.col(label))
    real = ~F.col(label).isin(*T.SENTINELS)
    starts, ends = real & lab.contains("start"), real & lab.contains("end")
    entry = real & ~lab.contains("end")

    def first(pred: Column) -> Column:
        # struct order = frame order; the time rides along
        return F.min(F.when(pred, F.struct(F.col(S.SEQ).alias("seq"), F.col(at).alias("t"))))

    found = frames.where(real).groupBy(*keys, base).agg(
        first(starts).alias("_s"), first(ends).alias("_e"), first(entry).alias("_n")
    )
    begin = F.coalesce("_s", "_n")
    return found.where(F.col("_e").isNotNull() & begin.isNotNull()).select(
        *keys,
        F.col(base).alias("_pair"),
        begin["t"].alias("_from"),
        F.col("_e.t").alias("_to"),
        F.struct(F.col("_s").isNull().alias("fallback"), begin["seq"].alias("seq")).alias("_rank"),
    )


def fill_between(
    frames: DataFrame,
    pairs: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
) -> DataFrame:
    """Label all frames strictly between the two ends of a pair; the later pair wins."""
    won = J.winning_interval(
        frames, pairs, keys, at, "_from", "_to", "_pair", "_rank", closed="neither"
    )
    out = frames.join(won, [*keys, S.SEQ], "left").withColumn(label, F.coalesce("_pair", label))
    return out.select(*frames.columns)


def fill_collision_tail(
    frames: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    label: str = "SpacialEvent",
    base: str = "BaseEvent",
    reason: str = "Reason",
    pattern: str = "collided-",
) -> DataFrame:
    """Extend the last event before a collision up to the row before the termination.

    Only empty labels are filled. Trips without a collision are untouched.
    """
    crash = (F.col(label) == "Termination") & F.lower(F.col(reason)).contains(pattern.lower())
    stops = frames.where(crash).groupBy(*keys).agg(F.min(S.SEQ).alias("_stop"))
    named = ~T.is_blank(F.col(label)) & ~F.col(label).isin(*T.SENTINELS)
    last = (
        J.lookup(frames.where(named).select(*keys, S.SEQ, label), stops, list(keys))
        .where(F.col(S.SEQ) < F.col("_stop"))
        .groupBy(*keys, "_stop")
        .agg(F.max(F.struct(F.col(S.SEQ).alias("seq"), F.col(label).alias("name"))).alias("_last"))
        .select(*keys, "_stop", F.col("_last.seq").alias("_last"), T.clean_event(F.col("_last.name")).alias("_tail"))
    )
    empty = T.is_blank(F.col(label)) | (F.col(label) == T.NO_EVENT)
    inside = (F.col(S.SEQ) > F.col("_last")) & (F.col(S.SEQ) < F.col("_stop")) & empty
    return (
        J.lookup(frames, last, list(keys), "left")
        .withColumn(base, F.when(inside, F.col("_tail")).otherwise(F.col(base)))
        .withColumn(label, F.when(inside, F.col("_tail")).otherwise(F.col(label)))
        .select(*frames.columns)
    )


def run_elapsed(
    frames: DataFrame,
    *,
    keys: Sequence[str],
    clock: str,
    label: str,
    valid: Column | None = None,
    out: str = "time_since_event_start_world",
) -> DataFrame:
    """Seconds since the current run of one label began; null on rows without an event.

    ``frames`` must be sequenced by ``clock``.
    """
    ok = T.is_real_event(F.col(label)) if valid is None else F.coalesce(valid, F.lit(False))
    marked = frames.withColumn("_ok", ok)
    prev = S.scan(marked, keys, _before=S.lag(F.when(F.col("_ok"), F.col(label))))
    begins = F.col("_ok") & ~F.col(label).eqNullSafe(F.col("_before"))
    starts = prev.withColumn("_begin", F.when(begins, F.col(clock)))
    held = S.scan(starts, keys, _begin=S.last_known("_begin"))
    return held.withColumn(out, F.when(F.col("_ok"), F.col(clock) - F.col("_begin"))).drop(
        "_ok", "_before", "_begin"
    )


def world_seconds(frames: DataFrame, *, keys: Sequence[str], text: str, out: str = "_world") -> DataFrame:
    """World time as seconds, with one reading per trip.

    Numeric if more than half of the values are numbers; else clock times if any
    parse; else date-times relative to the first valid one of the trip.
    """
    c = F.col(text).cast("string")
    read = frames.select(
        "*",
        N.number(c).alias("_num"),
        N.clock_seconds(c).alias("_clock"),
        N.datetime_seconds(c).alias("_date"),
    )
    whole = S.scan(
        read,
        keys,
        _n_num=S.total_count("_num"),
        _n=S.total_count(F.lit(1)),
        _n_clock=S.total_count("_clock"),
        _origin=S.first_of_all("_date"),
    )
    value = (
        F.when(F.col("_n_num") > 0.5 * F.col("_n"), F.col("_num"))
        .when(F.col("_n_clock") > 0, F.col("_clock"))
        .otherwise(F.col("_date") - F.col("_origin"))
    )
    return whole.withColumn(out, value).drop("_num", "_clock", "_date", "_n_num", "_n", "_n_clock", "_origin")


def spread_events(frames: DataFrame, *, keys: Sequence[str] = TRIP) -> DataFrame:
    """Spread point events over their spans: pair filling, then the collision tail."""
    base = frames.withColumn("BaseEvent", T.clean_event(F.col("SpacialEvent")))
    filled = materialize(fill_between(base, event_pairs(base, keys=keys), keys=keys), "filled")
    tailed = fill_collision_tail(filled, keys=keys)
    return tailed.withColumn("BaseEvent", T.clean_event(F.col("SpacialEvent")))


def propagate_events(
    frames: DataFrame, *, keys: Sequence[str] = TRIP, world_time: str = "WorldTime", chunk_bits: int = S.CHUNK_BITS
) -> DataFrame:
    """Spread point events over their spans and time every run of an event.

    ``frames`` is sequenced by simulation time and carries SpacialEvent and Reason.
    """
    clocked = world_seconds(spread_events(frames, keys=keys), keys=keys, text=world_time)
    return time_runs(clocked, keys=keys, chunk_bits=chunk_bits)


def time_runs(
    frames: DataFrame, *, keys: Sequence[str] = TRIP, clock: str = "_world", chunk_bits: int = S.CHUNK_BITS
) -> DataFrame:
    """:func:`run_elapsed` in world-time order, joined back to frames in their own order."""
    out = "time_since_event_start_world"
    kept = materialize(frames.drop(out), "events")
    narrow = kept.select(*keys, F.col(S.SEQ).alias("_row"), clock, T.clean_event(F.col("SpacialEvent")).alias("_ev"))
    byworld = S.sequence(narrow, keys, [F.col(clock).asc_nulls_last(), "_row"], chunk_bits)
    timed = run_elapsed(byworld, keys=keys, clock=clock, label="_ev", out=out)
    return kept.join(timed.select(*keys, F.col("_row").alias(S.SEQ), out), [*keys, S.SEQ], "left")
