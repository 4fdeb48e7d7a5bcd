"""Transcripts on frames and the first feedback of an event.

Segment tables have the trip keys, ``start``, ``end``, ``text``, ``speaker``,
``transcript_type`` and ``ord`` (record number in the file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import text as T
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators import trips as TR
from roadlens.operators.events import TRIP

TEXT_SEPARATOR = " | "


def best_transcripts(segments: DataFrame, *, keys: Sequence[str] = TRIP) -> DataFrame:
    """Manual segments of a trip if it has any, else the whisper ones.

    ``kind`` is TranscriptManual or TranscriptWhisper; a missing end is the start.
    """
    manual = segments.where(F.col("kind") == "TranscriptManual").select(*keys).distinct()
    has = segments.join(manual.withColumn("_manual", F.lit(True)), list(keys), "left")
    wanted = F.when(F.col("_manual"), "TranscriptManual").otherwise("TranscriptWhisper")
    return (
        has.where(F.col("kind") == wanted)
        .withColumn("transcript_type", F.when(F.col("_manual"), "manual").otherwise("whisper"))
        .withColumn("end", F.coalesce("end", "start"))
        .drop("_manual", "kind")
    )


def _append(current: Column, new: Column) -> Column:
    """Add ``new`` unless it equals everything accumulated so far."""
    return (
        F.when(T.is_blank(current), new)
        .when(new.isNull() | (current == new), current)
        .otherwise(F.concat(current, F.lit(TEXT_SEPARATOR), new))
    )


def fold_segments(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Concatenate the segments that meet on one row, in segment order.

    Texts are always appended; speaker and type only where they differ from the
    accumulated string, so ``a, b, a`` becomes ``a | b | a``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text", "speaker", "transcript_type")))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("text"), none.alias("speaker"), none.alias("kind"))

    def step(acc: Column, seg: Column) -> Column:
        fresh = T.is_blank(acc["text"])
        joined = F.concat(acc["text"], F.lit(TEXT_SEPARATOR), F.coalesce(seg["text"], F.lit("")))
        return F.struct(
            F.when(fresh, seg["text"]).otherwise(joined).alias("text"),
            F.when(fresh, seg["speaker"]).otherwise(_append(acc["speaker"], seg["speaker"])).alias("speaker"),
            F.when(fresh, seg["transcript_type"]).otherwise(_append(acc["kind"], seg["transcript_type"])).alias("kind"),
        )

    folded = hits.groupBy(*keys).agg(F.aggregate(ordered, start, step).alias("_f"))
    return folded.select(
        *keys, F.col("_f.text").alias("text"), F.col("_f.speaker").alias("speaker"), F.col("_f.kind").alias("transcript_type")
    )


def attach_transcripts(
    frames: DataFrame,
    segments: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    margin: float = 0.05,
) -> DataFrame:
    """Text, speaker and type on every frame within a segment widened by ``margin``.

    A segment that meets no frame goes to the frame nearest to its start. Overlaps
    are folded by :func:`fold_segments`.
    """
    keys = list(keys)
    s = segments.select(
        *keys, F.col("ord"), "text", T.strip(F.col("speaker")).alias("speaker"), "transcript_type",
        F.least("start", "end").alias("_from"), F.greatest("start", "end").alias("_to"),
    ).where("_from is not null")
    spans = s.withColumn("_left", F.col("_from") - margin).withColumn("_right", F.col("_to") + margin)
    covered = J.interval_join(
        frames.select(*keys, S.SEQ, at), spans.select(*keys, "ord", "_left", "_right"), keys, at, "_left", "_right"
    ).select(*keys, S.SEQ, "ord")
    lonely = spans.join(covered.select(*keys, "ord").distinct(), [*keys, "ord"], "left_anti").select(*keys, "ord", "_from")
    moved = J.nearest_row(frames, lonely, keys, at, "_from", adjacent=True).select(*keys, S.SEQ, "ord")
    hits = covered.unionByName(moved).join(s.drop("_from", "_to"), [*keys, "ord"])
    folded = fold_segments(hits, [*keys, S.SEQ])
    out = frames.drop("text", "speaker", "transcript_type").join(folded, [*keys, S.SEQ], "left")
    return out.withColumn("comment_flag", T.comment_flag(F.col("text")))


def flag_comment_starts(
    frames: DataFrame, segments: DataFrame, *, keys: Sequence[str] = TRIP, at: str = "SimulationTime"
) -> DataFrame:
    """``start_comment`` = 1 on the frame nearest to each segment start."""
    starts = segments.select(*keys, F.col("start").alias("_start"))
    return TR.flag_nearest(frames, starts, keys, at, "_start", out="start_comment", adjacent=True)


def flag_first_feedback(
    frames: DataFrame, *, keys: Sequence[str] = TRIP, label: str = "SpacialEvent", out: str = "first_feedback_in_event"
) -> DataFrame:
    """First comment start of the accompanier per event: 1 there, 0 on the event's
    other frames, null in events without one. Frames without an event form a group too."""
    core = frames.withColumn("_core", T.feedback_event(F.col(label)))
    hit = (F.col("start_comment") == 1) & T.is_accompanier(F.col("speaker"))
    return TR.first_flag(core, [*keys, "_core"], hit, out=out).drop("_core")
