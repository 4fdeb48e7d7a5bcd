"""Enrichment of the frames of many trips in one distributed job.

Frames are numbered once (trip, time order). Every later stage either adds
columns in place or makes a narrow side table keyed by (trip, row number) that
is joined back. Stages are cut by written tables, so each is read from columnar
files with known sizes and a lost executor never replays the whole chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens import schema as C
from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.operators import collision as K
from roadlens.operators import events as E
from roadlens.operators import lights as L
from roadlens.operators import objects as O
from roadlens.operators import scan as S
from roadlens.operators import speech as P
from roadlens.session import materialize
from roadlens.sources import logs, sinks

TRIP = ["Id", "Condition", "Map"]
ROW = [*TRIP, S.SEQ]


@dataclass(frozen=True)
class Inputs:
    """Typed inputs of all trips (see :mod:`roadlens.sources.logs`)."""

    trips: DataFrame
    frames: DataFrame
    tracks: DataFrame
    kinematic: DataFrame
    events: DataFrame
    junctions: DataFrame
    points: DataFrame
    transcripts: DataFrame


def read_inputs(
    spark: SparkSession,
    *,
    manifest: DataFrame,
    ego_root: str,
    object_root: str,
    kinematic_csv: str,
    events_csv: str,
    points_csv: str,
    transcripts_csv: str,
) -> Inputs:
    """One multi-file scan per kind of input for all trips of the manifest."""
    trips = manifest.select(*TRIP, "KinematicFile", "GPSFile")
    ego = logs.read_records(spark, ego_root, C.EGO_RECORD, trips, "KinematicFile")
    seen = logs.read_records(spark, object_root, C.OBJECT_RECORD, trips, "GPSFile")
    return Inputs(
        trips=trips,
        # raw text is parsed once; ``ord`` is fixed by the written table
        frames=logs.build_frames(materialize(ego, "ego")),
        tracks=materialize(logs.build_tracks(seen), "tracks"),
        kinematic=logs.read_kinematic(spark, kinematic_csv),
        events=logs.read_point_events(spark, events_csv),
        junctions=logs.read_junction_events(spark, events_csv),
        points=materialize(logs.read_points(spark, points_csv, trips), "points"),
        transcripts=materialize(logs.read_transcripts(spark, transcripts_csv), "transcripts"),
    )


def _side_join(frames: DataFrame, *sides: DataFrame) -> DataFrame:
    return reduce(lambda df, s: df.join(s, ROW, "left"), sides, frames)


def ordered_events(inputs: Inputs, chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Stage 1: frames with point events and interval flags, numbered in trip order."""
    all_events = E.synthesize_missing_starts(inputs.events)
    raw = inputs.frames.withColumn("_raw", F.col("SimulationTime"))
    marked = E.attach_point_events(raw, all_events)
    seq = S.sequence(marked, TRIP, ["SimulationTime", "_term", "ord", "SpacialEvent"], chunk_bits)
    flagged = E.flag_intervals(seq, inputs.kinematic, C.KINEMATIC_LABELS, row_id=[S.SEQ], at="_raw")
    return materialize(flagged.drop("_raw", "_term", "ord"), "ordered")


def enrich(inputs: Inputs, *, chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Frames of all trips with the 40 output columns."""
    tracks = inputs.tracks
    ordered = ordered_events(inputs, chunk_bits)
    spread = E.spread_events(ordered).withColumn("event_category", T.categorize(F.col("SpacialEvent")))
    labelled = materialize(spread, "labelled")

    event_objects = materialize(O.match_objects(inputs.points, tracks), "event-objects")
    overtake = O.sudden_stop_phases(labelled, tracks, event_objects, chunk_bits=chunk_bits)
    stages = materialize(O.pedestrian_stages(tracks, event_objects, inputs.points), "stages")
    marks = materialize(O.pedestrian_marks(labelled, stages), "marks")
    walked = materialize(O.apply_pedestrian_marks(_side_join(labelled, overtake), stages, marks), "walked")

    clocked = E.world_seconds(walked, keys=TRIP, text="WorldTime")
    timed = E.time_runs(clocked, chunk_bits=chunk_bits).drop("_world")
    near = O.event_distances(walked, tracks, event_objects, chunk_bits=chunk_bits)
    placed = materialize(_side_join(timed, near), "placed")

    critical = O.time_to_critical_point(placed, stages)
    junctions = L.junction_windows(inputs.junctions).join(inputs.trips.select(*TRIP), ["Id", "Condition"])
    phases = L.junction_phase(placed, junctions)
    lit = _side_join(L.light_state(placed, tracks), critical, phases)
    world_tracks = with_world_time(tracks, chunk_bits)
    gaps = K.own_gaps(placed, world_tracks, chunk_bits=chunk_bits)
    scene = materialize(K.attach_gaps(lit, gaps), "scene")

    ttc = K.time_to_collision(
        scene, tracks, K.first_police(tracks), K.ego_stop(scene), K.overtake_start(scene), chunk_bits=chunk_bits
    )
    chased = _side_join(scene, ttc).withColumn("Speed", F.coalesce("Speed", F.lit(0.0)))
    warned = materialize(chased, "warned")

    spoken = P.best_transcripts(inputs.transcripts)
    texted = materialize(P.attach_transcripts(warned, spoken), "texted")
    started = materialize(P.flag_comment_starts(texted, spoken), "started")
    return sinks.canonical(P.flag_first_feedback(started))


def with_world_time(tracks: DataFrame, chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Tracks with world time in seconds, read like the frames' world time."""
    seq = S.sequence(tracks, [*TRIP, "Name"], ["SimulationTime", "ord"], chunk_bits)
    text = F.col("WorldTime").cast("string")
    seconds = F.coalesce(N.clock_seconds(text), N.datetime_seconds(text), N.number(text))
    return seq.withColumn("_world", seconds).drop(S.SEQ, S.CHUNK)


def failures(trips: DataFrame, frames: DataFrame, rejected: DataFrame) -> DataFrame:
    """Every trip ends in the output or here: rejected ones plus those without any frame."""
    empty = trips.select(*TRIP).join(frames.select(*TRIP).distinct(), TRIP, "left_anti")
    lost = empty.select(*TRIP, F.lit("frames").alias("FailedStep"), F.lit("no readable or pairable records").alias("ErrorMessage"))
    return rejected.unionByName(lost)


def run(
    spark: SparkSession,
    *,
    manifest_csv: str,
    output: str,
    failed: str,
    only_ids: Sequence[str] | None = None,
    only_condition: str | None = None,
    done: DataFrame | None = None,
    **paths: str,
) -> None:
    """Read, enrich and append all trips that the output does not hold yet.

    The trips of ``output`` itself count as done; ``done`` names further ones.
    """
    good, rejected = logs.split_manifest(
        logs.read_manifest(spark, manifest_csv), only_ids=only_ids, only_condition=only_condition
    )
    for held in (sinks.finished(spark, output), done):
        good = good if held is None else logs.pending(good, held)
    todo = materialize(good, "manifest")
    inputs = read_inputs(spark, manifest=todo, **paths)
    result = materialize(enrich(inputs), "result")
    sinks.append_frames(result, output)
    sinks.append_failures(failures(todo, result, rejected), failed)
