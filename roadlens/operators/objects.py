"""Objects around the ego car: matching, distances, pedestrian stages, lead car.

Track tables have the trip keys, ``Name``, ``SimulationTime``, ``x``, ``y``,
``Latitude``, ``Longitude``, ``Speed`` and ``ord`` (record number in the file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import geometry as G
from roadlens.functions import text as T
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators.events import TRIP
from roadlens.operators.trips import sign_latch

# Stage texts and limits.
STAGES = ("start walking", "start crossing", "end crossing")
STOP_PHASES = ("start drive", "start brake", "stop", "restart drive")
MAX_STAGE_M = 15.0
BOX_TOLERANCE_M = 0.5
WESTBOUND_MAPS = ("A", "B")


def match_objects(
    points: DataFrame, tracks: DataFrame, *, keys: Sequence[str] = TRIP, tolerance: float = BOX_TOLERANCE_M
) -> DataFrame:
    """Per trip and reference point event the sorted array ``objects`` of matching names.

    A point with a light id matches the traffic light whose name ends in exactly
    that number; other points match every object seen inside their box.
    """
    keys = list(keys)
    lights = points.where(F.col("traffic_light_id").isNotNull()).select(
        "Map", "SpacialEvent", F.col("traffic_light_id").cast("long").alias("_light")
    )
    named = (
        tracks.where(F.col("Name").startswith("traffic.traffic_light"))
        .select(*keys, "Name")
        .distinct()
        .withColumn("_light", F.nullif(F.regexp_extract("Name", r"(\d+)$", 1), F.lit("")).try_cast("long"))
    )
    by_id = named.join(lights, ["Map", "_light"]).select(*keys, "SpacialEvent", "Name")
    boxes = points.where(F.col("traffic_light_id").isNull()).select(
        "Map", "SpacialEvent", F.col("x").alias("_px"), F.col("y").alias("_py")
    )
    seen = tracks.select(*keys, "Name", "x", "y")
    by_box = J.box_match(boxes, seen, ["Map"], ("_px", "_py"), ("x", "y"), tolerance)
    # every name once per event before it enters a group
    names = by_id.unionByName(by_box.select(*keys, "SpacialEvent", "Name")).distinct()
    return names.groupBy(*keys, "SpacialEvent").agg(F.array_sort(F.collect_set("Name")).alias("objects"))


def _candidates(frames: DataFrame, event_objects: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, frame label, event, object, position in the event's list) — small tables only."""
    labels = frames.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    wanted = event_objects.select(
        *keys, F.col("SpacialEvent").alias("_event"), T.match_label(F.col("SpacialEvent")).alias("_needle"), "objects"
    )
    police = F.filter("objects", lambda o: ~o.rlike(rf"^{T.POLICE_CAR}\s*\d*$"))
    several = F.size("objects") > 1
    return (
        labels.join(wanted, keys)
        .where(F.lower(F.col(label)).contains(F.lower(F.col("_needle"))))
        .select(
            *keys,
            label,
            "_event",
            several.alias("_several"),
            F.posexplode(F.when(several & F.col("Map").isin("A", "B"), police).otherwise(F.col("objects"))),
        )
        .withColumnRenamed("pos", "_pos")
        .withColumnRenamed("col", "Name")
    )


def event_distances(
    frames: DataFrame,
    tracks: DataFrame,
    event_objects: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """(keys, ``_seq``, distance_from_relevant_object, relevant_object_name) of event frames.

    Each candidate object of the frame's event is looked up at its sample nearest
    in time. With several candidates only those ahead in driving direction
    count. The closest wins; of several events on a frame, the last by name.
    """
    keys = list(keys)
    cands = _candidates(frames, event_objects, keys, label)
    probes = frames.select(*keys, S.SEQ, at, label, F.col("Latitude").alias("_lat"), F.col("Longitude").alias("_lon"))
    probes = probes.join(cands, [*keys, label]).drop(label)
    used = tracks.join(cands.select(*keys, "Name").distinct(), [*keys, "Name"], "left_semi")
    near = J.asof_join(
        probes, used, [*keys, "Name"], at, ["Latitude", "Longitude"], right_at="SimulationTime", right_order="ord",
        prefix="_o_", chunk_bits=chunk_bits,
    )
    westward = F.col("Map").isin(*WESTBOUND_MAPS)
    ahead = F.when(westward, F.col("_o_Longitude") <= F.col("_lon")).otherwise(F.col("_o_Longitude") >= F.col("_lon"))
    gap = G.haversine(F.col("_lat"), F.col("_lon"), F.col("_o_Latitude"), F.col("_o_Longitude"))
    scored = near.where(~F.col("_several") | ahead).withColumn("_d", gap).where(F.col("_d").isNotNull())
    best = F.max(
        F.struct(F.col("_event"), (-F.col("_d")).alias("nd"), (-F.col("_pos")).alias("np"), F.col("Name").alias("name"))
    )
    return scored.groupBy(*keys, S.SEQ).agg(best.alias("_b")).select(
        *keys,
        S.SEQ,
        (-F.col("_b.nd")).alias("distance_from_relevant_object"),
        F.col("_b.name").alias("relevant_object_name"),
    )


def sudden_stop_phases(
    frames: DataFrame,
    tracks: DataFrame,
    event_objects: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    rows: int = 5,
    drop: float = 5.0,
    still: float = 0.5,
    moving: float = 1.0,
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """(keys, ``_seq``, Overtake): phases of the lead car of the first overtake event.

    Each phase sits on the frame nearest in time; on one frame the later phase wins.
    """
    keys = list(keys)
    first = (
        event_objects.where(F.lower("SpacialEvent").contains("overtake"))
        .groupBy(*keys)
        .agg(F.min_by(F.element_at("objects", 1), "SpacialEvent").alias("Name"))
    )
    lead = tracks.join(first, [*keys, "Name"], "left_semi").select(*keys, "SimulationTime", "Speed", "ord")
    seq = S.sequence(lead, keys, ["SimulationTime", "ord"], chunk_bits)
    t, v = F.col("SimulationTime"), F.col("Speed")
    with_drop = S.neighbours(seq, keys, 0, rows, lambda w: {"_drop": v - F.lead("Speed", rows).over(w)})
    origin = seq.groupBy(*keys).agg(
        F.min_by("Speed", S.SEQ).alias("_v0"), F.min("SimulationTime").alias("_t0"), F.min(F.when(v > moving, t)).alias("_go")
    )
    waits = F.coalesce(F.col("_v0") < still, F.lit(False))
    drive = origin.select(*keys, F.when(waits, F.col("_go")).otherwise(F.col("_t0")).alias("_drive"))
    live = with_drop.join(drive, keys).where(t >= F.col("_drive"))
    marks = live.groupBy(*keys, "_drive").agg(
        F.min(F.when(F.col("_drop") >= drop, t)).alias("_brake"), F.min(F.when(v < still, t)).alias("_stop")
    )
    again = (
        live.join(marks.select(*keys, "_stop"), keys)
        .where((t > F.col("_stop")) & (v > moving))
        .groupBy(*keys)
        .agg(F.min(t).alias("_again"))
    )
    times = marks.join(again, keys, "left")
    phases = F.array(*[
        F.struct(F.lit(i).alias("_phase"), F.col(c).alias("_at"))
        for i, c in enumerate(("_drive", "_brake", "_stop", "_again"))
    ])
    targets = times.select(*keys, F.inline(phases)).where("_at is not null")
    hits = J.nearest_row(frames, targets, keys, at, "_at")
    names = F.array(*[F.lit(p) for p in STOP_PHASES])
    return hits.groupBy(*keys, S.SEQ).agg(F.get(names, F.max("_phase")).alias("Overtake"))


def pedestrian_stages(
    tracks: DataFrame,
    event_objects: DataFrame,
    points: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    max_m: float = MAX_STAGE_M,
    strict_after: bool = True,
) -> DataFrame:
    """One row per walker event: stage times and the crossing line.

    Stage 1 is the sample closest to the spawn point, stage 2 the later sample
    closest to the crossing start, stage 3 the sample after that closest to the
    crossing end (walker 1 walks back to the start). Stages 2 and 3 need the
    sample within ``max_m`` metres. Columns ``t1 t2 t3`` are null from the first
    missing stage on; ``ax ay bx by`` hold the positions at stages 2 and 3.
    """
    keys = list(keys)
    single = event_objects.where(
        F.lower("SpacialEvent").contains("walker") & (F.size("objects") == 1)
    ).select(*keys, F.trim("SpacialEvent").alias("event"), F.element_at("objects", 1).alias("Name"))
    spots = (
        points.select("Map", F.trim("SpacialEvent").alias("event"), "ord", "x", "y", "ped_start_lat", "ped_start_lon", "ped_end_lat", "ped_end_lon")
        .groupBy("Map", "event")
        .agg(F.min_by(F.struct("x", "y", "ped_start_lat", "ped_start_lon", "ped_end_lat", "ped_end_lon"), "ord").alias("p"))
        .where("p.x is not null and p.y is not null and p.ped_start_lat is not null and p.ped_start_lon is not null"
               " and p.ped_end_lat is not null and p.ped_end_lon is not null")
    )
    walkers = single.join(spots, ["Map", "event"])
    path = (
        tracks.select(*keys, "Name", "ord", "x", "y", F.col("SimulationTime").alias("t"),
                      F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
        .dropna(subset=["t", "lat", "lon", "x", "y"])
        .join(walkers, [*keys, "Name"])
        .withColumn("_o", F.struct("t", "ord"))
    )
    group = [*keys, "event", "Name"]

    def closest(df: DataFrame, dist, name: str) -> DataFrame:
        hit = F.min(F.struct(dist.alias("d"), F.col("_o").alias("o"), F.col("x").alias("x"), F.col("y").alias("y")))
        return df.groupBy(*group).agg(hit.alias(name))

    def after(order):
        return F.col("_o") > order if strict_after else F.col("_o") >= order

    s1 = closest(path, G.planar(F.col("x"), F.col("y"), F.col("p.x"), F.col("p.y")), "s1")
    to_start = G.haversine(F.col("lat"), F.col("lon"), F.col("p.ped_start_lat"), F.col("p.ped_start_lon"))
    s2 = closest(path.join(s1, group).where(after(F.col("s1.o"))), to_start, "s2").where(F.col("s2.d") <= max_m)
    back = F.regexp_extract("event", r"(?i)walker(\d+)", 1) == "1"
    to_end = G.haversine(
        F.col("lat"), F.col("lon"),
        F.when(back, F.col("p.ped_start_lat")).otherwise(F.col("p.ped_end_lat")),
        F.when(back, F.col("p.ped_start_lon")).otherwise(F.col("p.ped_end_lon")),
    )
    s3 = closest(path.join(s2, group).where(after(F.col("s2.o"))), to_end, "s3").where(F.col("s3.d") <= max_m)
    return s1.join(s2, group, "left").join(s3, group, "left").select(
        *group,
        F.col("s1.o.t").alias("t1"), F.col("s2.o.t").alias("t2"), F.col("s3.o.t").alias("t3"),
        *[F.when(F.col("s3").isNotNull(), F.col(f"{s}.{v}")).alias(f"{n}{v}") for s, n in (("s2", "a"), ("s3", "b")) for v in "xy"],
    )


def pedestrian_marks(
    frames: DataFrame, stages: DataFrame, *, keys: Sequence[str] = TRIP, at: str = "SimulationTime"
) -> DataFrame:
    """(keys, event, stage, ``_seq``): each stage on its nearest frame not used by the same walker before."""
    keys = list(keys)
    base = [*keys, "event"]
    m1 = J.nearest_row(frames, stages.select(*base, "t1"), keys, at, "t1").select(*base, F.col(S.SEQ).alias("m1"))
    m2 = J.nearest_row(
        frames, stages.join(m1, base).select(*base, "t2", "m1"), keys, at, "t2", exclude=["m1"]
    ).select(*base, F.col(S.SEQ).alias("m2"))
    m3 = J.nearest_row(
        frames, stages.join(m1, base).join(m2, base).select(*base, "t3", "m1", "m2"), keys, at, "t3", exclude=["m1", "m2"]
    ).select(*base, F.col(S.SEQ).alias("m3"))
    marked = m1.join(m2, base, "left").join(m3, base, "left")
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.col(f"m{i + 1}").alias(S.SEQ)) for i in range(3)])
    return marked.select(*base, F.inline(rows)).where(F.col(S.SEQ).isNotNull())


def apply_pedestrian_marks(
    frames: DataFrame,
    stages: DataFrame,
    marks: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    label: str = "SpacialEvent",
    out: str = "Pedestrian",
) -> DataFrame:
    """Write the stage texts and back-fill empty labels from the spawn to the event's first frame."""
    keys = list(keys)
    names = F.array(*[F.lit(s) for s in STAGES])
    ordered = F.array_sort(F.collect_list(F.struct("event", "stage")))
    texts = F.array_join(F.array_distinct(F.transform(ordered, lambda m: F.get(names, m["stage"]))), " | ")
    # at most three stages of each walker can meet on one frame
    noted = marks.groupBy(*keys, S.SEQ).agg(texts.alias(out))

    spawned = marks.where("stage = 0").join(
        frames.select(*keys, S.SEQ, F.col(at).alias("_ft")), [*keys, S.SEQ]
    ).select(*keys, "event", "_ft")
    opened = (
        frames.select(*keys, F.trim(label).alias("event"), at)
        .join(stages.select(*keys, "event"), [*keys, "event"], "left_semi")
        .groupBy(*keys, "event")
        .agg(F.min(at).alias("_to"))
    )
    spans = (
        stages.join(spawned, [*keys, "event"])
        .join(opened, [*keys, "event"])
        .select(*keys, "event", F.least("t1", "_ft").alias("_from"), "_to")
        .where("_from < _to")
    )
    empty = T.is_blank(F.col(label)) | F.trim(label).isin(T.NO_EVENT, "nan")
    gaps = frames.where(empty).select(*keys, S.SEQ, at)
    filled = (
        J.interval_join(gaps, spans, keys, at, "_from", "_to", closed="left")
        .groupBy(*keys, S.SEQ)
        .agg(T.clean_event(F.min("event")).alias("_fill"))
    )
    got = frames.drop(out).join(noted, [*keys, S.SEQ], "left").join(filled, [*keys, S.SEQ], "left")
    fill = F.col("_fill")
    return (
        got.withColumn(label, F.coalesce(fill, label))
        .withColumn("BaseEvent", F.coalesce(fill, "BaseEvent"))
        .withColumn("event_category", F.when(fill.isNotNull(), "Pedestrians").otherwise(F.col("event_category")))
        .drop("_fill")
    )


def time_to_critical_point(
    frames: DataFrame,
    stages: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    object_name: str = "relevant_object_name",
    min_speed: float = 0.5,
) -> DataFrame:
    """(keys, ``_seq``, time_to_critical_point) up to the moment the crossing line is passed.

    ``frames`` is sequenced by trip; the latch runs per trip and object, which is
    a refinement of that order.
    """
    keys = list(keys)
    lines = stages.where("bx is not null").select(*keys, F.col("Name").alias(object_name), "event", "ax", "ay", "bx", "by")
    lines = lines.groupBy(*keys, object_name).agg(F.max_by(F.struct("ax", "ay", "bx", "by"), "event").alias("_l"))
    near = frames.select(*keys, S.SEQ, S.CHUNK, F.trim(object_name).alias(object_name), "PositionX", "PositionY", "Speed")
    on = near.join(lines, [*keys, object_name])
    dist = G.signed_line_distance(
        F.col("PositionX"), F.col("PositionY"), F.col("_l.ax"), F.col("_l.ay"), F.col("_l.bx"), F.col("_l.by")
    )
    pace = F.col("Speed") / G.KMH_PER_MS
    on = on.withColumn("_d", dist)
    latched = sign_latch(on, [*keys, object_name], F.col("_d"), valid=(pace > min_speed) & F.col("_d").isNotNull(), out="_open")
    return latched.where("_open").select(*keys, S.SEQ, (F.abs("_d") / pace).alias("time_to_critical_point"))
