"""Quality report over the 40-column frame table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.operators import objects as O
from roadlens.operators import quality as Q
from roadlens.operators import scan as S
from roadlens.schema import CANONICAL_COLUMNS

TRIP = ["Id", "Condition", "Map"]

# The vocabulary of the columns and the limits of their values.
CONDITIONS = ("Conventional", "Avatar", "Remote")
MAPS = ("A", "B", "C")
EVENT_CATEGORIES = ("SimulationPoints", "Pedestrians", "Overtake", "TrafficLights", "GapAcceptance")
JUNCTION_PHASES = ("Approaching", "AtStopLine", "InsideJunction", "LeavingJunction")
LIGHTS = ("Green", "Yellow", "Red")
TRANSCRIPT_TYPES = ("manual", "whisper")
MAX_TTC_S = 10000.0
MAX_SPEED_KMH = 250.0
MIN_CORRELATION = 0.8
SHIFTED_FLAG = r"^(?!\s*[01](\.0)?\s*$)."


def checks() -> list[Q.Check]:
    """Checks that look at one row."""
    event = F.lower("SpacialEvent")
    stages = "|".join(O.STAGES)
    out = [
        Q.check_format("Id", r"^C\d+$"),
        Q.check_format("WorldTime", r"^\d{1,2}:\d{2}:\d{2}(\.\d+)?$", bad="WARN"),
        Q.check_enum("Condition", CONDITIONS),
        Q.check_enum("Map", MAPS),
        Q.check_enum("event_category", EVENT_CATEGORIES),
        Q.check_enum("Overtake", O.STOP_PHASES),
        Q.check_enum("TrafficLight", LIGHTS),
        Q.check_enum("TrafficLight_JunctionPhase", JUNCTION_PHASES),
        Q.check_enum("transcript_type", TRANSCRIPT_TYPES, bad="WARN"),
        Q.check_markers("Pedestrian", rf"^({stages})( \| ({stages}))*$"),
        Q.check_range("Speed", 0, MAX_SPEED_KMH),
        Q.check_range("Acceleration", 0),
        Q.check_range("distance_from_relevant_object", 0),
        Q.check_range("time_since_event_start_world", 0),
        Q.check_range("gap_acceptance", 0),
        Q.check_range("time_to_collision", 0, MAX_TTC_S),
        Q.check_near_zero("Speed", 1e-6, bad="WARN"),
        Q.check_iff("distance_from_relevant_object", "relevant_object_name"),
        Q.check_iff("time_to_collision", "ttc_object_name"),
        Q.check_implies("speaker", "text", bad="WARN"),
        Q.check_only_where("Reason", F.col("SpacialEvent") == "Termination", "Termination"),
        Q.check_only_where("gap_acceptance", event.contains("gap acceptance"), "gap"),
        Q.check_only_where("TrafficLight", F.col("event_category") == "TrafficLights", "light", bad="WARN"),
        Q.check_base_event(),
        Q.check_comment_flag(),
        Q.check_literal_null("speaker", bad="WARN"),
        Q.check_literal_null("text", bad="WARN"),
    ]
    binary = ("Braking", "Accelerating", "TurnRight", "TurnLeft", "comment_flag", "start_comment")
    return out + [Q.check_binary(c) for c in binary]


def structure(spark: SparkSession, path: str) -> DataFrame:
    """Report rows on the shape of a written frame file: a flag column of shifted records holds text of the column before it."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    ragged = Q.read_ragged(spark.createDataFrame([(name,)], "file string"), folder).where("ord > 0")  # the header is record 0
    return Q.check_structural(ragged, CANONICAL_COLUMNS, "first_feedback_in_event", SHIFTED_FLAG)


def report(frames: DataFrame, *more: DataFrame) -> DataFrame:
    """All report rows of a frame table and further report rows (:func:`structure`), ordered by column."""
    seq = S.sequence(frames, TRIP, ["SimulationTime", "FrameID"])
    by_frame = S.sequence(frames.select(*TRIP, "FrameID", "SimulationTime"), TRIP, ["FrameID"])
    return Q.report(
        *more,
        Q.run_checks(seq, checks(), S.SEQ),
        Q.check_rows_per_group(seq, "Id"),
        Q.check_monotone(seq, TRIP, "FrameID", bad="WARN"),
        Q.check_monotone(by_frame, TRIP, "SimulationTime"),
        Q.check_phase_order(seq, TRIP, "TrafficLight_JunctionPhase", JUNCTION_PHASES),
        Q.check_bounding_box(seq, "Latitude"),
        Q.check_bounding_box(seq, "Longitude"),
        Q.check_bounding_box(seq, "PositionX"),
        Q.check_bounding_box(seq, "PositionY"),
        Q.check_unique(seq, [*TRIP, "FrameID"]),
        Q.check_single_value(seq, TRIP, "transcript_type"),
        Q.check_presence(seq, "Condition", "Pedestrian", "crossing"),
        Q.check_variants(seq, "speaker"),
        Q.check_correlation(seq, TRIP, [("Longitude", "PositionX"), ("Latitude", "PositionY")], MIN_CORRELATION),
    )
