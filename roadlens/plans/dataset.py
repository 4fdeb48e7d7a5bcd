"""From enriched frames to window tables for models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.operators import windows as W
from roadlens.session import materialize
from roadlens.sources import sinks

AT = "time_since_event_start_world"


def light_frames(frames: DataFrame, feedback: str = "first_feedback_in_event") -> DataFrame:
    """Frames of traffic-light events with their key, row order and feedback flag."""
    key = T.event_key(F.col("Id"), F.col("Condition"), F.col("SpacialEvent"))
    world = F.coalesce(N.clock_seconds(F.col("WorldTime")), N.number(F.col("WorldTime")))
    order = F.struct(world.alias("w"), F.col("SimulationTime").alias("t"), F.col("FrameID").alias("f"))
    keyed = frames.withColumns({"event_id": key, "_order": order, "_told": F.coalesce(F.col(feedback) == 1, F.lit(False))})
    return keyed.where(F.col("event_id").isNotNull() & F.col(AT).isNotNull())


def build_windows(frames: DataFrame, sizes: Sequence[float] = (1.0,), feedback: str = "first_feedback_in_event") -> DataFrame:
    """Feature windows with targets for every size, in one table."""
    lights = materialize(light_frames(frames, feedback), "light-frames")
    told = lights.where("_told").select("event_id", F.col(AT).alias("feedback_at"))
    return sinks.combine_sizes(
        {s: W.window_targets(W.window_features(lights, size=s, at=AT, order="_order"), told) for s in sizes}
    )


def model_table(windows: DataFrame, ttc_fill: float | None = None) -> DataFrame:
    """Imputed windows with segment, imputed TTC and relative times."""
    clean = materialize(W.impute(windows, ttc_fill=ttc_fill), "clean")
    return W.segment_times(materialize(W.assign_segments(clean), "segments"))
