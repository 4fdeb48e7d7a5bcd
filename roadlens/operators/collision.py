"""Gaps in traffic, stops and time to collision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import geometry as G
from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.operators import joins as J
from roadlens.operators import scan as S
from roadlens.operators import trips as TR
from roadlens.operators.events import TRIP
from roadlens.session import materialize

# The event names per map and the reach of a collision.
GAP_PATTERNS = {
    "A": r"(?i)Egocar (?:start |end )?gap acceptance",
    "B": r"(?i)Egocar (?:start |end )?gap acceptance",
    "C": r"(?i)\bgap\s*acceptance\b",
}
MAX_TTC_DISTANCE_M = 200.0
OVERTAKE_ROWS = 15
OVERTAKE_THRESHOLD = -0.000001


def is_gap_frame(map_: Column, label: Column) -> Column:
    """Frame of a gap event, by the pattern of its map; unknown maps have none."""
    hit = F.lit(False)
    for name, pattern in GAP_PATTERNS.items():
        hit = hit | ((map_ == name) & label.rlike(pattern))
    return F.coalesce(hit, F.lit(False))


def _line(gap: DataFrame, tracks: DataFrame, keys: list[str], object_name: str, unit_scale: float, chunk_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of the gap frames' objects, distance travelled at each sample of those vehicles, and each vehicle's follower."""
    names = (
        gap.where(F.col(object_name).isNotNull())
        .select(*keys, F.explode(F.split(object_name, ", ")).alias("Name"))
        .distinct()
    )
    by = [*keys, "Name"]
    moves = tracks.join(names, by, "left_semi").select(*by, "SimulationTime", "_world", "Speed", "ord")
    seq = S.sequence(moves, by, ["_world", "ord"], chunk_bits)
    travelled = TR.cumulative_distance(seq, by, "_world", "Speed", out="_km")
    # order of appearance, then each vehicle's follower: one small row per vehicle
    line = Window.partitionBy(*keys).orderBy("_first", "Name")
    followers = (
        seq.groupBy(*by).agg(F.min("_world").alias("_first"))
        .select(*keys, F.col("Name").alias("object1"), F.lead("Name").over(line).alias("object2"))
        .where("object2 is not null")
    )
    marks = travelled.select(*by, "SimulationTime", (F.col("_km") * unit_scale).alias("_km")).withColumn("_side", F.lit(0))
    return names, marks, followers


def _reached(marks: DataFrame, probes: DataFrame, by: list[str], chunk_bits: int) -> DataFrame:
    """The probes with ``_far``, the largest distance that their vehicle has travelled by their time."""
    union = marks.unionByName(probes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    both = S.sequence(union, by, ["SimulationTime", "_side"], chunk_bits)
    return S.scan(both, by, _far=S.running_max("_km")).where("_side = 1").select(*probes.columns, "_far")


def _gap_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    one, two = F.col("CumulativeDistance_object1"), F.col("CumulativeDistance_object2")
    return pairs.select(*keys, "SimulationTime", "object1", "object2", one, two, F.abs(two - one).alias("GapAcceptance"))


def gap_table(
    frames: DataFrame,
    tracks: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    object_name: str = "relevant_object_name",
    unit_scale: float = 1.0,
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """Difference of travelled distance of all consecutive vehicles at every gap-event time.

    Vehicles are ordered by their first world time. The distance is speed (km/h)
    times seconds; ``unit_scale=1/3.6`` turns it into metres. ``tracks`` has
    ``_world`` seconds. Where only the gap of a frame's own vehicle is needed, :func:`own_gaps` asks for two vehicles a frame.
    """
    keys = list(keys)
    gap = frames.where(is_gap_frame(F.col("Map"), F.col("SpacialEvent")))
    names, marks, followers = _line(gap, tracks, keys, object_name, unit_scale, chunk_bits)
    probes = gap.select(*keys, F.col(at).alias("SimulationTime")).distinct().join(names, keys)
    reached = _reached(marks, probes, [*keys, "Name"], chunk_bits)
    one = reached.withColumnRenamed("Name", "object1").withColumnRenamed("_far", "CumulativeDistance_object1")
    two = reached.withColumnRenamed("Name", "object2").withColumnRenamed("_far", "CumulativeDistance_object2")
    return _gap_rows(one.join(followers, [*keys, "object1"]).join(two, [*keys, "object2", "SimulationTime"]), keys)


def own_gaps(
    frames: DataFrame,
    tracks: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    object_name: str = "relevant_object_name",
    unit_scale: float = 1.0,
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """The rows of :func:`gap_table` that :func:`attach_gaps` uses: the gap between each gap frame's own vehicle and its follower.

    A frame points to its vehicle's place in the line of vehicles and from there to the next one, so it makes two as-of probes,
    however many vehicles the trip has. Frames without an object, or with the last vehicle of the line, have no row.
    """
    keys = list(keys)
    gap = frames.where(is_gap_frame(F.col("Map"), F.col("SpacialEvent")))
    _, marks, followers = _line(gap, tracks, keys, object_name, unit_scale, chunk_bits)
    tenth = N.decisecond(F.col(at)).alias("_ds")
    times = gap.select(*keys, tenth, F.col(at).alias("SimulationTime")).distinct()
    own = frames.where(F.col(object_name).isNotNull()).select(*keys, tenth, F.col(object_name).alias("object1")).distinct()
    asked = times.join(own, [*keys, "_ds"]).drop("_ds").join(followers, [*keys, "object1"]).distinct()
    pair = [*keys, "SimulationTime", "object1", "object2"]
    side = F.explode(F.array(F.struct(F.col("object1").alias("Name"), F.lit(1).alias("n")), F.struct(F.col("object2").alias("Name"), F.lit(2).alias("n")))).alias("_p")
    probes = asked.select(*pair, side).select(*pair, "_p.Name", F.col("_p.n").alias("_n"))
    far = _reached(marks, probes, [*keys, "Name"], chunk_bits)
    both = [F.max(F.when(F.col("_n") == n, F.col("_far"))).alias(f"CumulativeDistance_object{n}") for n in (1, 2)]
    return _gap_rows(far.groupBy(*pair).agg(*both), keys)


def attach_gaps(frames: DataFrame, gaps: DataFrame, *, keys: Sequence[str] = TRIP, at: str = "SimulationTime") -> DataFrame:
    """Left join of the gap of the frame's own relevant object at the frame's tenth of a second."""
    narrow = gaps.select(
        *keys, N.decisecond(F.col("SimulationTime")).alias("_ds"), F.col("object1").alias("relevant_object_name"),
        F.col("GapAcceptance").alias("gap_acceptance"),
    )
    keyed = frames.withColumn("_ds", N.decisecond(F.col(at)))
    return keyed.join(narrow, [*keys, "_ds", "relevant_object_name"], "left").drop("_ds")


def first_police(tracks: DataFrame, *, keys: Sequence[str] = TRIP) -> DataFrame:
    """One row per trip: first sample of a police car, if there is one."""
    hit = F.struct("SimulationTime", "ord", "Name", "x", "y", "Latitude", "Longitude")
    return (
        tracks.where(F.col("Name").rlike(T.POLICE_CAR))
        .groupBy(*keys)
        .agg(F.min(hit).alias("p"))
        .select(*keys, F.col("p.Name").alias("police_name"), F.col("p.x").alias("police_x"), F.col("p.y").alias("police_y"),
                F.col("p.Latitude").alias("police_lat"), F.col("p.Longitude").alias("police_lon"))
    )


def distance_to_police(frames: DataFrame, police: DataFrame, *, keys: Sequence[str] = TRIP) -> DataFrame:
    """Distance of every frame to the trip's police car; trips without one drop out."""
    gap = G.haversine(F.col("Latitude"), F.col("Longitude"), F.col("police_lat"), F.col("police_lon"))
    return J.lookup(frames, police, list(keys)).select(
        *keys, S.SEQ, "SimulationTime", gap.alias("distance_to_police"), F.col("police_name").alias("police_object_name")
    )


def _ego_gap(frames: DataFrame) -> DataFrame:
    return frames.where(F.lower("SpacialEvent").contains(T.GAP_EVENT))


def overtake_start(frames: DataFrame, *, keys: Sequence[str] = TRIP, rows: int = OVERTAKE_ROWS, threshold: float = OVERTAKE_THRESHOLD) -> DataFrame:
    """Per trip the first time the latitude trend of the gap event turns down."""
    gap = _ego_gap(frames).select(*keys, "SimulationTime", "Latitude", S.SEQ, S.CHUNK)
    return TR.first_decline(gap, keys, "SimulationTime", "Latitude", rows=rows, threshold=threshold, out="overtake_time")


def ego_stop(frames: DataFrame, *, keys: Sequence[str] = TRIP, threshold: float = 0.3, min_duration: float = 1.0) -> DataFrame:
    """Per trip the start of the first sustained stop inside the gap event."""
    gap = _ego_gap(frames).select(*keys, "SimulationTime", (F.col("Speed") / G.KMH_PER_MS).alias("_mps"), S.SEQ, S.CHUNK)
    return TR.sustained_stop(gap, keys, "SimulationTime", "_mps", threshold=threshold, min_duration=min_duration, out="stop_time")


def track_velocity(tracks: DataFrame, by: Sequence[str], *, at: str = "SimulationTime", chunk_bits: int = S.CHUNK_BITS) -> DataFrame:
    """Finite-difference velocity at every sample with a position.

    Uses the step into the sample, for the first sample the step out of it; null
    where the step takes no time or the track has one sample only.
    """
    whole = tracks.where(F.col(at).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    seq = S.sequence(whole.select(*by, at, "x", "y", "ord"), by, [at, "ord"], chunk_bits)
    here = F.struct(F.col(at).alias("t"), "x", "y")
    near = S.scan(seq, by, _prev=S.lag(here), _next=S.lead(here))
    head = F.col("_prev").isNull()
    t0, t1 = F.when(head, F.col(at)).otherwise(F.col("_prev.t")), F.when(head, F.col("_next.t")).otherwise(F.col(at))
    dt = F.when(t1 - t0 > 0, t1 - t0)

    def rate(v: str) -> Column:
        return F.when(head, F.col(f"_next.{v}") - F.col(v)).otherwise(F.col(v) - F.col(f"_prev.{v}")) / dt

    return near.withColumn("vx", rate("x")).withColumn("vy", rate("y")).drop("_prev", "_next", S.SEQ, S.CHUNK)


def time_to_collision(
    frames: DataFrame,
    tracks: DataFrame,
    police: DataFrame,
    stops: DataFrame,
    overtakes: DataFrame,
    *,
    keys: Sequence[str] = TRIP,
    at: str = "SimulationTime",
    max_distance: float = MAX_TTC_DISTANCE_M,
    chunk_bits: int = S.CHUNK_BITS,
) -> DataFrame:
    """(keys, ``_seq``, time_to_collision, ttc_object_name) for the frames that have one.

    Gap events of maps A and B look at the police car until the ego car stops (or
    begins to overtake), then at the oncoming cars; pedestrian events at the
    walker; everything else at distance over speed.
    """
    keys = list(keys)
    x, y, v, yaw = F.col("PositionX"), F.col("PositionY"), F.coalesce("Speed", F.lit(0.0)), F.col("Yaw")
    phase = F.trim(F.coalesce("TrafficLight_JunctionPhase", F.lit("-")))
    usable = (v > 0) & yaw.isNotNull() & x.isNotNull() & y.isNotNull() & ~phase.isin("InsideJunction", "LeavingJunction", "")
    small = police.join(stops, keys, "full").join(overtakes, keys, "full")
    live = J.lookup(frames.where(usable), small, keys, "left")
    gap = F.coalesce(F.col("Map").isin("A", "B") & F.lower("SpacialEvent").contains(T.GAP_EVENT), F.lit(False))
    border = F.coalesce("stop_time", "overtake_time")
    facing_police = gap & F.coalesce(F.col(at) < border, F.lit(False)) & F.col("police_x").isNotNull()
    walker = F.trim(F.coalesce("event_category", F.lit(""))) == "Pedestrians"
    live = live.withColumn(
        "_branch", F.when(facing_police, "police").when(gap, "oncoming").when(walker, "walker").otherwise("generic")
    )

    to_police = G.planar(x, y, F.col("police_x"), F.col("police_y"))
    p_ttc = G.ttc_static(x, y, v, yaw, F.col("police_x"), F.col("police_y"))
    plain = live.where(F.col("_branch").isin("police", "generic")).select(
        *keys,
        S.SEQ,
        F.when(F.col("_branch") == "generic", G.ttc_generic(F.col("distance_from_relevant_object"), v))
        .when((to_police > 0) & (to_police <= max_distance), p_ttc)
        .alias("time_to_collision"),
        F.when(F.col("_branch") == "generic", F.col("relevant_object_name")).otherwise(F.col("police_name")).alias("ttc_object_name"),
    )

    several = F.filter(F.transform(F.split("relevant_object_name", ","), lambda n: F.trim(n)), lambda n: n != "")
    names = F.when(F.col("_branch") == "oncoming", several).otherwise(F.array("relevant_object_name"))
    chased = live.where(F.col("_branch").isin("oncoming", "walker") & ~T.is_blank(F.col("relevant_object_name"))).select(
        *keys, S.SEQ, at, "_branch", x.alias("_x"), y.alias("_y"), v.alias("_v"), yaw.alias("_yaw"), F.posexplode(names)
    ).withColumnRenamed("pos", "_pos").withColumnRenamed("col", "Name")
    by = [*keys, "Name"]
    wanted = tracks.join(chased.select(*by).distinct(), by, "left_semi")
    moving = track_velocity(wanted, by, chunk_bits=chunk_bits)
    near = J.asof_join(chased, moving, by, at, ["x", "y", "vx", "vy"], right_at="SimulationTime", right_order="ord", prefix="_o_", chunk_bits=chunk_bits)
    args = [F.col(c) for c in ("_x", "_y", "_v", "_yaw", "_o_x", "_o_y", "_o_vx", "_o_vy")]
    ttc = F.when(F.col("_branch") == "oncoming", G.ttc_range_rate(*args)).otherwise(G.ttc_quadratic(*args))
    reach = G.planar(F.col("_x"), F.col("_y"), F.col("_o_x"), F.col("_o_y")) <= max_distance
    # a narrow written table: the long formulas are then compiled once, over plain columns
    timed = materialize(near.where(reach & F.col("_o_vx").isNotNull()), "chased").select(*keys, S.SEQ, "Name", "_pos", ttc.alias("_ttc"))
    best = F.min(F.when(F.col("_ttc").isNotNull(), F.struct(F.col("_ttc").alias("ttc"), F.col("_pos").alias("pos"), F.col("Name").alias("name"))))
    hit = (
        timed.groupBy(*keys, S.SEQ).agg(best.alias("_b")).where(F.col("_b").isNotNull())
        .select(*keys, S.SEQ, F.col("_b.ttc").alias("time_to_collision"), F.col("_b.name").alias("ttc_object_name"))
    )
    return plain.where("time_to_collision is not null").unionByName(hit)
