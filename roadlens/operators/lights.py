"""Traffic-light state and junction phase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators.events import TRIP
from roadlens.operators.trips import fill_states

# Fixed values, in the order of driving.
PHASES = ("Approaching", "InsideJunction", "AtStopLine", "LeavingJunction")


def light_state(
    frames: DataFrame, tracks: DataFrame, *, keys: Sequence[str] = TRIP, at: str = "SimulationTime"
) -> DataFrame:
    """Add ``TrafficLight``: state of the relevant light, filled forward per light.

    One state per tenth of a second and light, so repeated tenths copy no rows.
    If the first known state is Yellow, earlier frames take its previous state.
    """
    keys = list(keys)
    by = [*keys, "relevant_object_name"]
    states = (
        tracks.where(F.col("CurrentState").isNotNull())
        .groupBy(*keys, F.col("Name").alias("relevant_object_name"), N.decisecond(F.col("SimulationTime")).alias("_ds"))
        .agg(F.max(F.struct("SimulationTime", "ord", "CurrentState", "PreviousState")).alias("_st"))
    )
    near = frames.where(
        (F.col("event_category") == "TrafficLights") & F.col("relevant_object_name").isNotNull()
    ).select(*by, S.SEQ, S.CHUNK, N.decisecond(F.col(at)).alias("_ds"))
    joined = near.join(states, [*by, "_ds"], "left").select(
        *by, S.SEQ, S.CHUNK, "_ds", F.col("_st.CurrentState").alias("_cur"), F.col("_st.PreviousState").alias("_old")
    )
    filled = fill_states(joined, by, "_cur", "_old", trigger="yellow", out="TrafficLight")
    per_tenth = filled.groupBy(*by, "_ds").agg(F.max_by("TrafficLight", S.SEQ).alias("TrafficLight"))
    keyed = frames.drop("TrafficLight").withColumn("_ds", N.decisecond(F.col(at)))
    return keyed.join(per_tenth, [*by, "_ds"], "left").drop("_ds")


def junction_windows(events: DataFrame, *, keys: Sequence[str] = ("Id", "Condition"), at: str = "SimulationTime", label: str = "Event_Name") -> DataFrame:
    """Per trip and light the first start, entry and end, if they come in this order."""
    parsed = events.select(
        *keys, F.col(at).alias("t"), T.light_number(F.col(label)).alias("tl"), T.light_event_kind(F.col(label)).alias("kind")
    ).where("tl is not null and t is not null")
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("t")))
    found = parsed.groupBy(*keys, "tl").agg(first("start").alias("s"), first("entry").alias("e"), first("end").alias("x"))
    ts = F.coalesce("s", "e")
    te = F.coalesce(F.col("e"), ts)
    return found.select(*keys, "tl", ts.alias("ts"), te.alias("te"), F.col("x").alias("tx")).where("ts <= te and te <= tx")


def junction_phase(
    frames: DataFrame,
    windows: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
    out: str = "TrafficLight_JunctionPhase",
) -> DataFrame:
    """(keys, ``_seq``, phase) from the windows of each light, given per trip.

    Window ends move to their nearest frames; phases are ranges of frame
    positions. Inside a window the later phase wins, of two windows the later one.
    """
    keys = list(keys)
    base = [*keys, "tl", "ts"]
    ends = F.array(*[F.struct(F.lit(i).alias("_end"), F.col(c).alias("_at")) for i, c in enumerate(("ts", "te", "tx"))])
    targets = windows.select(*base, F.inline(ends))
    spots = J.nearest_row(frames, targets, keys, at, "_at").groupBy(*base).agg(
        *[F.max(F.when(F.col("_end") == i, F.col(S.SEQ))).alias(n) for i, n in enumerate(("i", "e", "x"))]
    ).where("i <= e and e <= x")
    # last frame at or after the exit that still carries this light's event
    own = frames.select(*keys, S.SEQ, T.light_number(F.col(label)).alias("tl")).where("tl is not null")
    last = (
        own.join(spots.select(*keys, "tl", "x"), [*keys, "tl"])
        .where(F.col(S.SEQ) >= F.col("x"))
        .groupBy(*keys, "tl")
        .agg(F.max(S.SEQ).alias("_last"))
    )
    done = spots.join(last, [*keys, "tl"], "left").withColumn("_last", F.coalesce("_last", "x"))
    spans = F.array(*[
        F.struct(F.lit(p).alias("_phase"), F.lit(i).alias("_step"), lo.alias("_lo"), hi.alias("_hi"))
        for i, (p, lo, hi) in enumerate(zip(
            PHASES,
            (F.col("i"), F.col("e") + 1, F.col("e"), F.col("x")),
            (F.col("e") - 1, F.col("x") - 1, F.col("e"), F.col("_last")),
        ))
    ])
    ranges = done.select(*base, F.inline(spans)).select(
        *keys, "_lo", "_hi", "_phase", F.struct("ts", "tl", "_step").alias("_rank")
    )
    return _phase_rows(frames, ranges, keys).withColumnRenamed("_phase", out)


def _phase_rows(frames: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Frames inside each position range, met through the chunks the range touches.

    Positions have gaps between sort partitions, so chunks serve as the buckets.
    """
    bounds = frames.groupBy(*keys, S.CHUNK).agg(F.min(S.SEQ).alias("_c0"), F.max(S.SEQ).alias("_c1"))
    touched = ranges.join(bounds, keys).where((F.col("_lo") <= F.col("_c1")) & (F.col("_hi") >= F.col("_c0")))
    narrow = frames.select(*keys, S.CHUNK, S.SEQ)
    inside = narrow.join(touched.drop("_c0", "_c1"), [*keys, S.CHUNK]).where(
        (F.col(S.SEQ) >= F.col("_lo")) & (F.col(S.SEQ) <= F.col("_hi"))
    )
    return inside.groupBy(*keys, S.SEQ).agg(F.max_by("_phase", "_rank").alias("_phase"))
