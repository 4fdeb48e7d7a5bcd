"""Schemas and column lists of the log format (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

# the 40 output columns, in order
CANONICAL_COLUMNS = (
    "Id", "Condition", "Map", "FrameID", "WorldTime", "SimulationTime",
    "Longitude", "Latitude", "PositionX", "PositionY", "Acceleration", "Speed",
    "Yaw", "SteeringAngle", "Brake", "Braking", "Accelerating", "TurnRight", "TurnLeft",
    "SpacialEvent", "Reason", "BaseEvent", "time_since_event_start_world",
    "event_category", "Overtake", "distance_from_relevant_object",
    "relevant_object_name", "time_to_critical_point", "Pedestrian", "TrafficLight",
    "TrafficLight_JunctionPhase", "gap_acceptance", "time_to_collision",
    "ttc_object_name", "text", "speaker", "transcript_type", "comment_flag",
    "start_comment", "first_feedback_in_event",
)

_LONG = {"FrameID"}
_INT = {
    "Braking", "Accelerating", "TurnRight", "TurnLeft", "comment_flag", "start_comment", "first_feedback_in_event",
}
_TEXT = {
    "Id", "Condition", "Map", "WorldTime", "SpacialEvent", "Reason", "BaseEvent", "event_category", "Overtake",
    "relevant_object_name", "Pedestrian", "TrafficLight", "TrafficLight_JunctionPhase", "ttc_object_name", "text",
    "speaker", "transcript_type",
}

FRAMES = T.StructType(
    [
        T.StructField(
            c,
            T.LongType() if c in _LONG else T.IntegerType() if c in _INT else T.StringType() if c in _TEXT else T.DoubleType(),
        )
        for c in CANONICAL_COLUMNS
    ]
)

FAILURES = T.StructType([T.StructField(c, T.StringType()) for c in ("Id", "Condition", "Map", "FailedStep", "ErrorMessage")])

KINEMATIC_LABELS = ("Braking", "Accelerating", "TurnRight", "TurnLeft")

# Log values are read as text and coerced, so a malformed number is a null and no lost record.
_TEXT_FIELDS = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_XY = T.StructType(_TEXT_FIELDS("x", "y", "z"))

EGO_RECORD = T.StructType(
    _TEXT_FIELDS("Type", "FrameID", "WorldTime", "SimulationTime", "Longitude", "Latitude", "Speed", "SteeringAngle",
                 "Brake", "Acceleration", "Reason", "Event_Name", "LaneID")
    + [T.StructField("SimulationPosition", _XY), T.StructField("Orientation", _XY)]
)

OBJECT_RECORD = T.StructType(
    _TEXT_FIELDS("Name", "Type", "SimulationTime", "WorldTime", "Latitude", "Longitude", "Speed", "CurrentState", "PreviousState")
    + [T.StructField("SimulationPosition", _XY)]
)
