"""Readers for the raw files of many trips at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens import schema as C
from roadlens.functions import numeric as N
from roadlens.functions import text as X
from roadlens.operators import joins as J
from roadlens.sources.json_ranges import read_log_records

TRIP = ["Id", "Condition", "Map"]


def read_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """CSV with a header, all columns as text, header names without BOM and stray blanks."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"', mode="PERMISSIVE")
    return raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).select("Id", "Condition", "Map", "Scenario", "triggered_by", "KinematicFile", "GPSFile")


def split_manifest(
    manifest: DataFrame,
    *,
    prefix: str = "C",
    scenario: str = "Accompanied",
    skip: Sequence[str] = ("training", "baseline"),
    only_ids: Sequence[str] | None = None,
    only_condition: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Trips to process and failure rows for trips without their files.

    ``only_ids``/``only_condition`` restrict the run to single participants or trips.
    """
    wanted = manifest.where(
        F.col("Id").startswith(prefix)
        & (F.col("Scenario") == scenario)
        & (F.lower(F.trim("triggered_by")) == "egocar")
        & ~F.coalesce(F.lower(F.trim("Condition")).isin(*skip), F.lit(False))
    )
    if only_ids is not None:
        wanted = wanted.where(F.col("Id").isin(*only_ids))
    if only_condition is not None:
        wanted = wanted.where(F.col("Condition") == only_condition)
    no_ego, no_objects = X.is_blank(F.col("KinematicFile")), X.is_blank(F.col("GPSFile"))
    bad = wanted.where(no_ego | no_objects)
    failures = bad.select(
        *TRIP,
        F.when(no_ego, "KinematicFile").otherwise("GPSFile").alias("FailedStep"),
        F.lit("missing file name").alias("ErrorMessage"),
    )
    # of several rows of one trip the first in file order counts
    placed = wanted.where(~no_ego & ~no_objects).withColumn("_ord", F.monotonically_increasing_id())
    whole = F.struct(*[F.col(f"`{c}`") for c in manifest.columns])
    good = placed.groupBy(*TRIP).agg(F.min_by(whole, "_ord").alias("_row")).select("_row.*")
    return good, failures


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Trips without rows in an existing output (resume)."""
    return manifest.join(done.select(*TRIP).distinct(), TRIP, "left_anti")


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``, for file URIs and for plain or already relative names."""
    plain = F.regexp_replace(path, r"^[a-zA-Z0-9]+:/+", "/")
    slashed = F.translate(plain, "\\", "/")
    stem = root.split(":", 1)[-1].replace("//", "/").rstrip("/") + "/"
    return F.when(slashed.startswith(stem), F.substr(slashed, F.lit(len(stem) + 1))).otherwise(slashed)


def read_records(
    spark: SparkSession, root: str, record: T.StructType, trips: DataFrame, file_column: str
) -> DataFrame:
    """Log records of all trips: trip keys, ``ord`` and the record's fields.

    A file holds ``{"Logs": [...]}`` or a plain array. Unreadable files give no records. Files are found by the names of
    the trips, below ``root``, and are read in byte ranges (:mod:`roadlens.sources.json_ranges`).
    """
    named = trips.select(*TRIP, _relative(F.col(file_column), root).alias("file")).where("file is not null")
    return read_log_records(named, root, record).join(named, "file").drop("file")


def magnitude(value: Column) -> Column:
    """Vector length of a JSON object (missing parts are 0); a plain number passes through."""

    def length(v: Column) -> Column:
        square = lambda p: F.pow(F.coalesce(N.number(v[p]), F.lit(0.0)), 2)
        return F.sqrt(square("x") + square("y") + square("z"))

    # the lambda binds the parsed object, so the text is parsed once
    parsed = F.array(F.from_json(value, "x string, y string, z string"))
    return F.when(F.ltrim(value).startswith("{"), F.get(F.transform(parsed, length), F.lit(0))).otherwise(N.number(value))


def ego_records(records: DataFrame) -> DataFrame:
    """Typed ego records; type and frame number follow the record order where a trip has none."""
    typed = records.select(
        *TRIP,
        "ord",
        X.normalize_type(F.col("Type")).alias("Type"),
        N.number(F.col("FrameID")).try_cast("long").alias("FrameID"),
        "WorldTime",
        *[N.number(F.col(c)).alias(c) for c in ("SimulationTime", "Longitude", "Latitude", "Speed", "SteeringAngle", "Brake")],
        magnitude(F.col("Acceleration")).alias("Acceleration"),
        N.number(F.col("SimulationPosition.x")).alias("PositionX"),
        N.number(F.col("SimulationPosition.y")).alias("PositionY"),
        N.number(F.col("Orientation.y")).alias("Yaw"),
    )
    known = typed.groupBy(*TRIP).agg(
        F.count("Type").alias("_types"), F.count("FrameID").alias("_ids"), F.min("ord").alias("_first")
    )
    place = F.col("ord") - F.col("_first")
    both = J.lookup(typed, known, TRIP)
    return both.withColumn(
        "Type",
        F.when(F.col("_types") > 0, F.col("Type")).otherwise(F.when(place % 2 == 0, "GPS").otherwise("Car_Telemetries")),
    ).withColumn("FrameID", F.when(F.col("_ids") > 0, F.col("FrameID")).otherwise(place)).drop("_types", "_ids", "_first")


def pair_offsets(gps: DataFrame, telemetry: DataFrame, keys: Sequence[str] = TRIP) -> DataFrame:
    """Per trip the frame offset that pairs telemetry with GPS: 0, 1, -1, or no row.

    0 if any frame number is shared; otherwise, where the majority parities
    differ, telemetry one ahead, and if that meets nothing, one behind.
    """
    keys = list(keys)
    shift = F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("off")
    g = gps.select(*keys, "FrameID", F.lit(1).alias("g"), F.lit(0).alias("t"), shift)
    t = telemetry.select(*keys, "FrameID", F.lit(0).alias("g"), F.lit(1).alias("t"), shift)
    t = t.withColumn("FrameID", F.col("FrameID") - F.col("off"))
    met = (
        g.unionByName(t)
        .groupBy(*keys, "off", "FrameID")
        .agg(F.max("g").alias("g"), F.max("t").alias("t"))
        .where("g = 1 and t = 1")
        .groupBy(*keys)
        .agg(*[F.bool_or(F.col("off") == o).alias(n) for o, n in ((0, "same"), (1, "plus"), (-1, "minus"))])
    )

    def odd(df: DataFrame, name: str) -> DataFrame:
        share = F.avg((F.col("FrameID") % 2 != 0).cast("int"))
        return df.groupBy(*keys).agg((share > 0.5).alias(name))

    chosen = met.join(odd(gps, "_g"), keys).join(odd(telemetry, "_t"), keys)
    return chosen.select(
        *keys,
        F.when(F.col("same"), 0)
        .when((F.col("_g") != F.col("_t")) & F.col("plus"), 1)
        .when((F.col("_g") != F.col("_t")) & F.col("minus"), -1)
        .alias("off"),
    ).where("off is not null")


def pair_frames(gps: DataFrame, telemetry: DataFrame, keys: Sequence[str] = TRIP) -> DataFrame:
    """Inner join of GPS and telemetry rows on the trip's pairing."""
    keys = list(keys)
    g, t = gps.where("FrameID is not null"), telemetry.where("FrameID is not null")
    off = pair_offsets(g, t, keys)
    shifted = J.lookup(t, off, keys).withColumn("FrameID", F.col("FrameID") - F.col("off")).drop("off")
    return g.join(shifted, [*keys, "FrameID"])


def build_frames(records: DataFrame) -> DataFrame:
    """Frame table of all trips: paired GPS/telemetry rows and termination rows.

    ``ord`` and ``_term`` order rows of one time: file order, terminations last.
    """
    ego = ego_records(records)
    gps = ego.where("Type = 'GPS'").select(
        *TRIP, "ord", "FrameID", "WorldTime", "SimulationTime", "Longitude", "Latitude", "PositionX", "PositionY", "Acceleration", "Yaw"
    )
    tele = ego.where("Type = 'Car_Telemetries'").select(*TRIP, "FrameID", "Speed", "SteeringAngle", "Brake")
    ends = ego.where("Type = 'Termination'").select(*TRIP, "ord", "FrameID", "WorldTime", "SimulationTime", F.lit(1).alias("_term"))
    paired = pair_frames(gps, tele).withColumn("_term", F.lit(0))
    return paired.unionByName(ends, allowMissingColumns=True)


def build_tracks(records: DataFrame) -> DataFrame:
    """Typed object tracks of all trips."""
    return records.select(
        *TRIP,
        "ord",
        "Name",
        "WorldTime",
        *[N.number(F.col(c)).alias(c) for c in ("SimulationTime", "Latitude", "Longitude", "Speed")],
        N.number(F.col("SimulationPosition.x")).alias("x"),
        N.number(F.col("SimulationPosition.y")).alias("y"),
        "CurrentState",
        "PreviousState",
    )


def read_kinematic(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path)
    require(raw, ["Id", "Condition", "Map", "triggered_by", "Event_Name", "Onset.SimulationTime", "End.SimulationTime"])
    return raw.where((F.col("triggered_by") == "Egocar") & F.col("Event_Name").isin(*C.KINEMATIC_LABELS)).select(
        *TRIP,
        N.number(F.col("`Onset.SimulationTime`")).alias("start"),
        N.number(F.col("`End.SimulationTime`")).alias("end"),
        F.col("Event_Name").alias("label"),
    )


def read_point_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the ego car at places or at start/end; Reason only on terminations."""
    raw = read_csv(spark, path)
    require(raw, ["Id", "Condition", "triggered_by", "Type", "Event_Name", "SimulationTime"])
    kind = X.strip(F.col("Type"))
    rows = raw.where(
        (F.col("triggered_by") == "Egocar") & (kind.contains("Spacial") | kind.contains("Start/End Simulation"))
    )
    return rows.select(
        "Id",
        "Condition",
        N.number(F.col("SimulationTime")).alias("SimulationTime"),
        X.normalize_walker(F.col("Event_Name")).alias("SpacialEvent"),
        F.when(X.normalize_walker(F.col("Event_Name")) == "Termination", _col(raw, "Reason")).alias("Reason"),
    )


def read_junction_events(spark: SparkSession, path: str, scenario: str = "Accompanied") -> DataFrame:
    """Light events for the junction phases: every ego event of the scenario, whatever its type."""
    raw = read_csv(spark, path)
    require(raw, ["Id", "Condition", "Scenario", "triggered_by", "Event_Name", "SimulationTime"])
    return raw.where((X.strip(F.col("Scenario")) == scenario) & (X.strip(F.col("triggered_by")) == "Egocar")).select(
        X.strip(F.col("Id")).alias("Id"), X.strip(F.col("Condition")).alias("Condition"),
        N.number(F.col("SimulationTime")).alias("SimulationTime"), X.strip(F.col("Event_Name")).alias("Event_Name"),
    )


def read_points(spark: SparkSession, path: str, maps: DataFrame | None = None) -> DataFrame:
    """Reference points; with ``maps`` only those of maps present in it."""
    raw = read_csv(spark, path)
    require(raw, ["Map", "SpacialEvent", "SimulationPosition.x", "SimulationPosition.y"])
    out = raw.select(
        "Map",
        "SpacialEvent",
        F.monotonically_increasing_id().alias("ord"),
        N.number(F.col("`SimulationPosition.x`")).alias("x"),
        N.number(F.col("`SimulationPosition.y`")).alias("y"),
        N.number(_col(raw, "traffic_light_id")).try_cast("long").alias("traffic_light_id"),
        *[N.number(_col(raw, c)).alias(c) for c in ("ped_start_lat", "ped_start_lon", "ped_end_lat", "ped_end_lon")],
    )
    return out if maps is None else out.join(maps.select("Map").distinct(), "Map", "left_semi")


def read_transcripts(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    raw = read_csv(spark, path, multiline=multiline)
    require(raw, ["triggered_by", "Type", "Event_Name", "Id", "Condition", "Map", "SimulationTime", "SimulationTimeEnd", "text", "speaker"])
    return raw.withColumn("ord", F.monotonically_increasing_id()).where(
        (X.strip(F.col("triggered_by")) == "Egocar") & (X.strip(F.col("Type")) == "Transcript")
    ).select(
        *[X.strip(F.col(c)).alias(c) for c in TRIP], "ord", X.strip(F.col("Event_Name")).alias("kind"),
        N.number(F.col("SimulationTime")).alias("start"), N.number(F.col("SimulationTimeEnd")).alias("end"), "text", "speaker",
    )


def profile(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per column, from one pass over the whole table.

    Type, rows, nulls, an estimate of the distinct values (a HyperLogLog sketch, about 2 % off), least and greatest value, for numbers
    mean, deviation and approximate quartiles, and with ``order`` the values of the first and the last row. Values are shown as text.
    """
    numbers = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    place = F.struct(*[F.col(f"`{c}`") for c in order]) if order else None
    aggs = []
    for i, (c, t) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        text = v.cast("string") if not t.startswith(("array", "map", "struct", "binary")) else F.base64(v) if t == "binary" else F.to_json(F.array(v))
        none = F.lit(None).cast("double")
        x = v.cast("double")
        shown = v if not t.startswith("map") else text  # maps have no order
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.count_if(v.isNull()).alias("nulls"),
                F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(text, F.lit(12))), F.lit(0).cast("long")).alias("distinct_estimate"),
                F.min(shown).cast("string").alias("least"), F.max(shown).cast("string").alias("greatest"),
                *[(f(x) if c in numbers else none).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))],
                *[(F.percentile_approx(x, q, 10000) if c in numbers else none).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))],
                *[(f(v, place).cast("string") if order else F.lit(None).cast("string")).alias(n) for n, f in (("first", F.min_by), ("last", F.max_by))],
            ).alias(f"c{i}")
        )
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return one.select("rows", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])))


def head_and_tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first and the last ``n`` rows by ``order``, marked ``part``; no more than these leave a task."""
    head = df.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    return head.unionByName(df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("part", F.lit("tail")))
