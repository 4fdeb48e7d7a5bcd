"""Object, light and speech operators on the shipped tables.

Every user is a trip; some of their events play the ego car, others the objects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.catalog import query
from roadlens.operators import collision as K
from roadlens.operators import lights as L
from roadlens.operators import objects as O
from roadlens.operators import scan as S
from roadlens.operators import speech as P
from roadlens.session import materialize
from roadlens.sources import shipped as D

TRIP = ["Id", "Condition", "Map"]

# all trips on map A or C by the user number's parity; coordinates from the measures
_TRIPS_SQL = f"""{D.FRAMES_SQL},
drv AS (SELECT trip AS "Id", CASE trip % 2 WHEN 0 THEN 'A' ELSE 'C' END AS "Map", t, ord, label, value, k,
  value / 1000 AS lat, k / 1000 AS lon, CAST(round_even(t / 3600, 0) AS BIGINT) AS ds FROM frames)"""


def _drive(spark, sf):
    f = D.frames(spark, sf)
    return f.select(
        F.col("trip").alias("Id"),
        F.lit("x").alias("Condition"),
        F.when(F.col("trip") % 2 == 0, "A").otherwise("C").alias("Map"),
        (F.col("t") / 36000).alias("SimulationTime"),
        "t", "ord", "label", "value", "k",
        (F.col("value") / 1000).alias("Latitude"),
        (F.col("k") / 1000).alias("Longitude"),
        F.col("value").alias("x"),
        F.col("k").alias("y"),
        F.col("value").alias("Speed"),
    )


def _frames(drive, *columns):
    return S.sequence(drive.select(*TRIP, "SimulationTime", "t", "ord", *columns), TRIP, ["t", "ord"])


def _tracks(drive, labels):
    name = F.concat(F.lit("car "), F.col("label"))
    return drive.where(F.col("label").isin(*labels)).withColumn("Name", name).drop("label")


@query(
    "event_objects",
    """WITH names AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS id, 'traffic.traffic_light ' || l_suppkey AS name, l_suppkey AS light FROM lineitem),
obj AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS id, 'part ' || (l_partkey % 50) AS name, l_quantity * 2 AS x, l_discount * 500 AS y FROM lineitem),
hit AS (SELECT id, 'light ' || (s_suppkey // 10) AS ev, name FROM names JOIN supplier ON light = s_suppkey
  UNION SELECT id, n_name AS ev, name FROM obj JOIN nation ON abs(x - n_nationkey * 4.25) <= 0.75 AND abs(y - n_regionkey * 10.25) <= 0.75)
SELECT id AS "Id", ev AS "SpacialEvent", string_agg(name, ', ' ORDER BY name) AS objects FROM hit GROUP BY id, ev""",
)
def event_objects(spark, sf):
    """Suppliers as numbered lights, nations as places: the objects of every event."""
    li = D.motion(spark, sf)
    base = [F.col("l_linenumber").cast("long").alias("Id"), F.lit("x").alias("Condition"), F.lit("A").alias("Map"), "x", "y"]
    tracks = li.select(*base, F.concat(F.lit("traffic.traffic_light "), F.col("l_suppkey").cast("string")).alias("Name")).withColumns(
        {"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}
    ).unionByName(li.select(*base, F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("Name")))
    lights = D.table(spark, sf, "supplier").select(
        F.lit("A").alias("Map"), F.concat(F.lit("light "), F.floor(F.col("s_suppkey") / 10).cast("string")).alias("SpacialEvent"),
        F.col("s_suppkey").alias("traffic_light_id"),
    )
    places = D.table(spark, sf, "nation").select(
        F.lit("A").alias("Map"), F.col("n_name").alias("SpacialEvent"), (F.col("n_nationkey") * 4.25).alias("x"), (F.col("n_regionkey") * 10.25).alias("y")
    )
    out = O.match_objects(lights.unionByName(places, allowMissingColumns=True), tracks, tolerance=0.75)
    return out.select("Id", "SpacialEvent", F.array_join("objects", ", ").alias("objects"))


def _hav(a, b, c, d):
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@query(
    "haversine_nearest",
    f"""WITH {_TRIPS_SQL},
tr AS (SELECT "Id", 'car ' || label AS name, t, ord, lat, lon FROM drv WHERE label IN ('view', 'click')),
pr AS (SELECT f.*, e.ev, e.name, e.several FROM drv f JOIN (VALUES ('error', 'Start error', 'car click', true), ('error', 'Start error', 'car view', true),
   ('purchase', 'purchase', 'car view', false)) e(label, ev, name, several) ON f.label = e.label),
b AS (SELECT p.*, q.t AS bt, q.lat AS blat, q.lon AS blon FROM pr p ASOF LEFT JOIN tr q ON p."Id" = q."Id" AND p.name = q.name AND p.t >= q.t),
n AS (SELECT b.*, q.t AS ft, q.lat AS flat, q.lon AS flon FROM b ASOF LEFT JOIN tr q ON b."Id" = q."Id" AND b.name = q.name AND b.t <= q.t),
o AS (SELECT *, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN blat ELSE flat END AS olat,
   CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN blon ELSE flon END AS olon FROM n),
d AS (SELECT *, {_hav('lat', 'lon', 'olat', 'olon')} AS dist FROM o WHERE olat IS NOT NULL
   AND (NOT several OR CASE WHEN "Map" = 'A' THEN olon <= lon ELSE olon >= lon END)),
r AS (SELECT *, row_number() OVER (PARTITION BY "Id", ord ORDER BY dist, name) AS rn FROM d)
SELECT "Id", ord, round(dist, 3) AS distance, name AS object FROM r WHERE rn = 1""",
)
def haversine_nearest(spark, sf):
    """Distance of event frames to the closest candidate ahead, each at its nearest sample."""
    drive = _drive(spark, sf)
    frames = _frames(drive.withColumn("SimulationTime", F.col("t")), "label", "Latitude", "Longitude")
    tracks = _tracks(drive, ["view", "click"]).withColumn("SimulationTime", F.col("t"))
    users = drive.select(*TRIP).distinct()
    wanted = F.array(
        F.struct(F.lit("Start error").alias("SpacialEvent"), F.array(F.lit("car click"), F.lit("car view")).alias("objects")),
        F.struct(F.lit("purchase").alias("SpacialEvent"), F.array(F.lit("car view")).alias("objects")),
    )
    found = O.event_distances(frames, tracks, users.select(*TRIP, F.inline(wanted)), label="label")
    return found.join(frames.select(*TRIP, S.SEQ, "ord"), [*TRIP, S.SEQ]).select(
        "Id", "ord", F.round("distance_from_relevant_object", 3).alias("distance"), F.col("relevant_object_name").alias("object")
    )


@query(
    "phase_transitions",
    f"""WITH {_TRIPS_SQL},
v AS (SELECT *, value - lead(value, 5) OVER (PARTITION BY "Id" ORDER BY t, ord) AS dp, row_number() OVER (PARTITION BY "Id" ORDER BY t, ord) AS rn FROM drv WHERE label = 'view'),
g AS (SELECT "Id", CASE WHEN max(CASE WHEN rn = 1 THEN value END) < 10 THEN min(CASE WHEN value > 20 THEN t END) ELSE min(t) END AS go FROM v GROUP BY "Id"),
l AS (SELECT v.*, go FROM v JOIN g USING ("Id") WHERE t >= go),
m AS (SELECT "Id", go, min(CASE WHEN dp >= 15 THEN t END) AS brake, min(CASE WHEN value < 10 THEN t END) AS stop FROM l GROUP BY "Id", go),
a AS (SELECT l."Id", min(l.t) AS again FROM l JOIN m USING ("Id") WHERE l.t > m.stop AND value > 20 GROUP BY l."Id"),
p AS (SELECT "Id", 0 AS ph, go AS pt FROM m UNION ALL SELECT "Id", 1, brake FROM m UNION ALL SELECT "Id", 2, stop FROM m UNION ALL SELECT "Id", 3, again FROM a),
n AS (SELECT p."Id", ph, arg_min(f.ord, (abs(f.t - pt), f.t, f.ord)) AS ord FROM p JOIN drv f ON f."Id" = p."Id" AND f.label <> 'view' WHERE pt IS NOT NULL GROUP BY p."Id", ph)
SELECT "Id", ord, CASE max(ph) WHEN 0 THEN 'start drive' WHEN 1 THEN 'start brake' WHEN 2 THEN 'stop' ELSE 'restart drive' END AS phase FROM n GROUP BY "Id", ord""",
)
def phase_transitions(spark, sf):
    """Start, brake, stop and restart of the lead car on the nearest frames."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    frames = _frames(drive.where("label <> 'view'"))
    lead = drive.select(*TRIP).distinct().withColumns({"SpacialEvent": F.lit("Start overtake"), "objects": F.array(F.lit("car view"))})
    out = O.sudden_stop_phases(frames, _tracks(drive, ["view"]), lead, drop=15.0, still=10.0, moving=20.0)
    return out.join(frames.select(*TRIP, S.SEQ, "ord"), [*TRIP, S.SEQ]).select("Id", "ord", F.col("Overtake").alias("phase"))


@query(
    "staged_argmin",
    f"""WITH {_TRIPS_SQL},
w AS (SELECT * FROM drv WHERE label = 'click'),
s1 AS (SELECT "Id", arg_min(t, (sqrt((value - 20) * (value - 20) + (k - 50) * (k - 50)), t, ord)) AS t1 FROM w GROUP BY "Id"),
d2 AS (SELECT w.*, {_hav('lat', 'lon', '0.01', '0.02')} AS d FROM w JOIN s1 USING ("Id") WHERE w.t > t1),
s2 AS (SELECT "Id", arg_min(t, (d, t, ord)) AS t2 FROM d2 GROUP BY "Id" HAVING min(d) <= 4000),
d3 AS (SELECT w.*, {_hav('lat', 'lon', '0.03', '0.08')} AS d FROM w JOIN s2 USING ("Id") WHERE w.t > t2),
s3 AS (SELECT "Id", arg_min(t, (d, t, ord)) AS t3, arg_min(value, (d, t, ord)) AS bx FROM d3 GROUP BY "Id" HAVING min(d) <= 4000)
SELECT "Id", t1, t2, t3, bx FROM s1 LEFT JOIN s2 USING ("Id") LEFT JOIN s3 USING ("Id")""",
)
def staged_argmin(spark, sf):
    """Three stages of a walker, each the closest sample after the one before."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    tracks = materialize(_tracks(drive, ["click"]), "tracks")
    walkers = drive.select(*TRIP).distinct().withColumns({"SpacialEvent": F.lit("Start walker2"), "objects": F.array(F.lit("car click"))})
    spots = drive.select("Map").distinct().withColumns({
        "SpacialEvent": F.lit("Start walker2"), "ord": F.lit(0), "x": F.lit(20.0), "y": F.lit(50.0), "ped_start_lat": F.lit(0.01),
        "ped_start_lon": F.lit(0.02), "ped_end_lat": F.lit(0.03), "ped_end_lon": F.lit(0.08),
    })
    out = O.pedestrian_stages(tracks, walkers, spots, max_m=4000.0)
    return out.select("Id", "t1", "t2", "t3", "bx")


@query(
    "cumulative_gap",
    f"""WITH {_TRIPS_SQL},
mv AS (SELECT "Id", 'car ' || label AS name, t, ord, value * coalesce(t - lag(t) OVER (PARTITION BY "Id", label ORDER BY t, ord), 0) AS part FROM drv WHERE label IN ('view', 'click')),
cu AS (SELECT *, sum(part) OVER (PARTITION BY "Id", name ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS km FROM mv),
fs AS (SELECT "Id", name, min(t) AS f FROM mv GROUP BY "Id", name),
nx AS (SELECT "Id", name AS object1, lead(name) OVER (PARTITION BY "Id" ORDER BY f, name) AS object2 FROM fs),
tm AS (SELECT DISTINCT "Id", t FROM drv WHERE label = 'error'),
rc AS (SELECT tm."Id", tm.t, n.name, max(cu.km) AS far FROM tm JOIN fs n USING ("Id") LEFT JOIN cu ON cu."Id" = tm."Id" AND cu.name = n.name AND cu.t <= tm.t GROUP BY tm."Id", tm.t, n.name)
SELECT a."Id", a.t, object1, object2, round(abs(b.far - a.far) / 1000, 3) AS gap FROM rc a JOIN nx ON nx."Id" = a."Id" AND nx.object1 = a.name
 JOIN rc b ON b."Id" = a."Id" AND b.t = a.t AND b.name = nx.object2 WHERE object2 IS NOT NULL""",
)
def cumulative_gap(spark, sf):
    """Gap between consecutive vehicles at every event time."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    lab = F.when(F.col("label") == "error", "Egocar gap acceptance").otherwise("None")
    frames = _frames(drive.withColumn("SpacialEvent", lab).withColumn("relevant_object_name", F.lit("car view, car click")), "SpacialEvent", "relevant_object_name")
    tracks = _tracks(drive, ["view", "click"]).withColumn("_world", F.col("t"))
    out = K.gap_table(frames, tracks, unit_scale=0.001)
    return out.select("Id", F.col("SimulationTime").alias("t"), "object1", "object2", F.round("GapAcceptance", 3).alias("gap"))


@query(
    "own_gap",
    f"""WITH {_TRIPS_SQL},
gf AS (SELECT "Id", t, round_even(t * 10, 0) AS ds, CASE ord % 3 WHEN 0 THEN 'car view' WHEN 1 THEN 'car click' ELSE 'car signup, car view' END AS rel FROM drv WHERE label = 'error'),
nm AS (SELECT DISTINCT "Id", unnest(string_split(rel, ', ')) AS name FROM gf),
mv AS (SELECT "Id", 'car ' || label AS name, t, ord, value * coalesce(t - lag(t) OVER (PARTITION BY "Id", label ORDER BY t, ord), 0) AS part FROM drv
  WHERE label IN ('view', 'click', 'signup') AND ("Id", 'car ' || label) IN (SELECT ("Id", name) FROM nm)),
cu AS (SELECT *, sum(part) OVER (PARTITION BY "Id", name ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS km FROM mv),
nx AS (SELECT "Id", name AS object1, lead(name) OVER (PARTITION BY "Id" ORDER BY f, name) AS object2 FROM (SELECT "Id", name, min(t) AS f FROM mv GROUP BY "Id", name)),
ak AS (SELECT DISTINCT a."Id", a.t, b.rel AS object1 FROM gf a JOIN gf b ON a."Id" = b."Id" AND a.ds = b.ds),
pr AS (SELECT ak."Id", ak.t, ak.object1, object2, (SELECT max(km) FROM cu WHERE cu."Id" = ak."Id" AND cu.name = ak.object1 AND cu.t <= ak.t) AS one,
  (SELECT max(km) FROM cu WHERE cu."Id" = ak."Id" AND cu.name = nx.object2 AND cu.t <= ak.t) AS two
  FROM ak JOIN nx ON nx."Id" = ak."Id" AND nx.object1 = ak.object1 WHERE object2 IS NOT NULL)
SELECT "Id", t, object1, object2, round(one / 1000, 3) AS one, round(two / 1000, 3) AS two, round(abs(two - one) / 1000, 3) AS gap FROM pr""",
)
def own_gap(spark, sf):
    """Gap between each gap frame's own vehicle and the one that follows it."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    gap, kind = F.col("label") == "error", F.col("ord") % 3
    name = F.when(kind == 0, "car view").when(kind == 1, "car click").otherwise("car signup, car view")
    labelled = drive.withColumn("SpacialEvent", F.when(gap, "Egocar gap acceptance").otherwise("None")).withColumn("relevant_object_name", F.when(gap, name))
    frames = _frames(labelled, "SpacialEvent", "relevant_object_name")
    tracks = _tracks(drive, ["view", "click", "signup"]).withColumn("_world", F.col("t"))
    out = K.own_gaps(frames, tracks, unit_scale=0.001)
    one, two = F.col("CumulativeDistance_object1"), F.col("CumulativeDistance_object2")
    return out.select("Id", F.col("SimulationTime").alias("t"), "object1", "object2", *[F.round(c, 3).alias(n) for n, c in (("one", one), ("two", two), ("gap", F.col("GapAcceptance")))])


@query(
    "police_distance",
    f"""WITH {_TRIPS_SQL},
p AS (SELECT "Id", arg_min(lat, (t, ord)) AS plat, arg_min(lon, (t, ord)) AS plon FROM drv WHERE label = 'view' AND k > 50 GROUP BY "Id")
SELECT f."Id", f.ord, round({_hav('f.lat', 'f.lon', 'plat', 'plon')}, 3) AS distance FROM drv f JOIN p USING ("Id")""",
)
def police_distance(spark, sf):
    """Distance of every frame to the first sample of the trip's police car."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    tracks = _tracks(drive.where("k > 50"), ["view"]).withColumn("Name", F.lit("vehicle.dodge.charger_police 1"))
    frames = _frames(drive, "Latitude", "Longitude")
    out = K.distance_to_police(frames, K.first_police(tracks))
    return out.join(frames.select(*TRIP, S.SEQ, "ord"), [*TRIP, S.SEQ]).select("Id", "ord", F.round("distance_to_police", 3).alias("distance"))


_VEL = """ob AS (SELECT "Id", 'car ' || label AS name, t, ord, value AS x, k AS y FROM drv WHERE label IN ('view', 'click')),
nb AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ob WINDOW w AS (PARTITION BY "Id", name ORDER BY t, ord)),
ve AS (SELECT *, CASE WHEN pt IS NULL THEN (nx - x) / (nt - t) ELSE (x - px) / (t - pt) END AS vx, CASE WHEN pt IS NULL THEN (ny - y) / (nt - t) ELSE (y - py) / (t - pt) END AS vy FROM nb)"""


@query(
    "track_velocity",
    f"""WITH {_TRIPS_SQL}, {_VEL}
SELECT "Id", name AS "Name", ord, round(vx * 1000, 6) AS vx, round(vy * 1000, 6) AS vy FROM ve""",
)
def track_velocity(spark, sf):
    """Finite-difference velocity of every object sample."""
    tracks = _tracks(_drive(spark, sf), ["view", "click"])
    out = K.track_velocity(tracks, [*TRIP, "Name"], at="t")
    return out.select("Id", "Name", "ord", F.round(F.col("vx") * 1000, 6).alias("vx"), F.round(F.col("vy") * 1000, 6).alias("vy"))


@query(
    "collision_branches",
    f"""WITH {_TRIPS_SQL}, {_VEL},
po AS (SELECT "Id", arg_min(value, (t, ord)) AS px, arg_min(k, (t, ord)) AS py FROM drv WHERE label = 'view' AND k > 50 GROUP BY "Id"),
eg AS (SELECT d.*, value / 2 AS ex, 100 - k AS ey, k * 3.6 AS yaw, CASE WHEN label = 'error' THEN CASE WHEN "Map" <> 'A' THEN 'generic' WHEN t < 1000000 AND po.px IS NOT NULL THEN 'police' ELSE 'oncoming' END
   WHEN label = 'signup' THEN 'walker' ELSE 'generic' END AS br, po.px, po.py FROM drv d LEFT JOIN po USING ("Id") WHERE label IN ('error', 'signup', 'purchase') AND value > 0),
ev AS (SELECT *, value / 3.6 * cos(radians(yaw)) AS cx, value / 3.6 * sin(radians(yaw)) AS cy FROM eg),
r1 AS (SELECT "Id", ord, CASE WHEN br = 'generic' THEN CASE WHEN k > 0 AND value / 3.6 > 0.5 THEN k / (value / 3.6) END
   WHEN pd > 0 AND pd <= 200 THEN CASE WHEN pd < 1e-6 THEN 0 WHEN ((px - ex) * cx + (py - ey) * cy) / pd > 0.5 THEN pd / (((px - ex) * cx + (py - ey) * cy) / pd) END END AS ttc,
   CASE WHEN br = 'generic' THEN CASE WHEN label = 'signup' THEN 'car view' ELSE 'car click, car view' END ELSE 'vehicle.dodge.charger_police 1' END AS nm
   FROM (SELECT *, sqrt((px - ex) * (px - ex) + (py - ey) * (py - ey)) AS pd FROM ev) WHERE br IN ('generic', 'police')),
pr AS (SELECT e.*, c.name, c.pos FROM ev e JOIN (VALUES ('oncoming', 'car click', 0), ('oncoming', 'car view', 1), ('walker', 'car view', 0)) c(br, name, pos) ON e.br = c.br),
b AS (SELECT p.*, q.t AS bt, q.x AS b1, q.y AS b2, q.vx AS b3, q.vy AS b4 FROM pr p ASOF LEFT JOIN ve q ON p."Id" = q."Id" AND p.name = q.name AND p.t >= q.t),
n AS (SELECT b.*, q.t AS ft, q.x AS f1, q.y AS f2, q.vx AS f3, q.vy AS f4 FROM b ASOF LEFT JOIN ve q ON b."Id" = q."Id" AND b.name = q.name AND b.t <= q.t),
o AS (SELECT *, bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) AS back FROM n),
s AS (SELECT *, CASE WHEN back THEN b1 ELSE f1 END - ex AS rx, CASE WHEN back THEN b2 ELSE f2 END - ey AS ry, CASE WHEN back THEN b3 ELSE f3 END - cx AS wx, CASE WHEN back THEN b4 ELSE f4 END - cy AS wy FROM o),
z AS (SELECT *, sqrt(rx * rx + ry * ry) AS d, wx * wx + wy * wy AS qa, 2 * (rx * wx + ry * wy) AS qb, rx * rx + ry * ry - 4 AS qc FROM s WHERE wx IS NOT NULL),
y AS (SELECT *, CASE WHEN qb * qb - 4 * qa * qc >= 0 AND qa >= 1e-8 THEN sqrt(qb * qb - 4 * qa * qc) END AS rt FROM z WHERE d <= 200),
x AS (SELECT "Id", ord, name, pos, CASE WHEN br = 'oncoming' THEN CASE WHEN d < 1e-6 THEN 0 WHEN -(rx * wx + ry * wy) / d > 0.5 THEN d / (-(rx * wx + ry * wy) / d) END
   ELSE CASE WHEN qc <= 0 THEN 0 WHEN rt IS NULL THEN NULL WHEN (-qb - rt) / (2 * qa) > 1e-8 THEN (-qb - rt) / (2 * qa) WHEN (-qb + rt) / (2 * qa) > 1e-8 THEN (-qb + rt) / (2 * qa) END END AS ttc FROM y),
m AS (SELECT *, row_number() OVER (PARTITION BY "Id", ord ORDER BY ttc, pos) AS rn FROM x WHERE ttc IS NOT NULL)
SELECT "Id", ord, round(ttc, 5) AS ttc, nm AS object FROM r1 WHERE ttc IS NOT NULL UNION ALL SELECT "Id", ord, round(ttc, 5), name FROM m WHERE rn = 1""",
)
def collision_branches(spark, sf):
    """Time to collision with the police car, oncoming cars, walkers and plain objects."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    lab = F.col("label")
    ego = drive.where(lab.isin("error", "signup", "purchase")).withColumns({
        "SpacialEvent": F.when(lab == "error", "Egocar gap acceptance").otherwise("None"),
        "event_category": F.when(lab == "signup", "Pedestrians"),
        "relevant_object_name": F.when(lab == "signup", "car view").otherwise("car click, car view"),
        "distance_from_relevant_object": F.col("k"), "TrafficLight_JunctionPhase": F.lit("Approaching"),
        "PositionX": F.col("value") / 2, "PositionY": 100 - F.col("k"), "Yaw": F.col("k") * 3.6,
    })
    frames = _frames(ego, "SpacialEvent", "event_category", "relevant_object_name", "distance_from_relevant_object", "TrafficLight_JunctionPhase",
                     "PositionX", "PositionY", "Yaw", "Speed")
    tracks = materialize(_tracks(drive, ["view", "click"]), "tracks")
    police = K.first_police(tracks.where("Name = 'car view' and k > 50").withColumn("Name", F.lit("vehicle.dodge.charger_police 1")))
    trips = frames.select(*TRIP).distinct()
    stops = trips.withColumn("stop_time", F.lit(None).cast("double"))
    starts = trips.withColumn("overtake_time", F.lit(1000000.0))
    out = K.time_to_collision(frames, tracks, police, stops, starts)
    return out.join(frames.select(*TRIP, S.SEQ, "ord"), [*TRIP, S.SEQ]).select(
        "Id", "ord", F.round("time_to_collision", 5).alias("ttc"), F.col("ttc_object_name").alias("object")
    )


@query(
    "light_state",
    f"""WITH {_TRIPS_SQL},
st AS (SELECT "Id", CASE WHEN k < 50 THEN 'L1' ELSE 'L2' END AS name, ds, arg_max(label, (t, ord)) AS cur, last(CASE WHEN value < 30 THEN 'Green' END ORDER BY t, ord) AS old
  FROM drv WHERE label IN ('click', 'view', 'purchase') GROUP BY ALL),
fr AS (SELECT "Id", ord, t, ds, CASE WHEN value < 20 THEN 'L1' ELSE 'L2' END AS name FROM drv WHERE label <> 'signup'),
j AS (SELECT fr.*, CASE cur WHEN 'click' THEN 'Green' WHEN 'view' THEN 'Yellow' WHEN 'purchase' THEN 'Red' END AS cur, old FROM fr LEFT JOIN st USING ("Id", name, ds)),
f AS (SELECT *, last_value(cur IGNORE NULLS) OVER (PARTITION BY "Id", name ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fill FROM j),
h AS (SELECT "Id", name, first(cur ORDER BY t, ord) AS c0, first(old ORDER BY t, ord) AS p0 FROM j WHERE cur IS NOT NULL GROUP BY "Id", name),
s AS (SELECT f.*, coalesce(fill, CASE WHEN c0 = 'Yellow' THEN p0 END) AS state FROM f LEFT JOIN h USING ("Id", name)),
l AS (SELECT "Id", name, ds, last(state ORDER BY t, ord) AS state FROM s GROUP BY "Id", name, ds)
SELECT d."Id", d.ord, l.state AS light FROM drv d LEFT JOIN l ON l."Id" = d."Id" AND l.ds = d.ds AND l.name = CASE WHEN d.value < 20 THEN 'L1' ELSE 'L2' END""",
)
def light_state(spark, sf):
    """State of the relevant light per frame: joined, filled forward, prefix before a first Yellow."""
    drive = _drive(spark, sf)
    lab = F.col("label")
    frames = _frames(drive.withColumns({
        "event_category": F.when(lab != "signup", "TrafficLights"), "relevant_object_name": F.when(F.col("value") < 20, "L1").otherwise("L2"),
    }), "event_category", "relevant_object_name")
    tracks = drive.withColumns({
        "Name": F.when(F.col("k") < 50, "L1").otherwise("L2"),
        "CurrentState": F.when(lab == "click", "Green").when(lab == "view", "Yellow").when(lab == "purchase", "Red"),
        "PreviousState": F.when(F.col("value") < 30, "Green"),
    })
    return L.light_state(frames, tracks).select("Id", "ord", F.col("TrafficLight").alias("light"))


@query(
    "junction_phase",
    f"""WITH {_TRIPS_SQL},
ev AS (SELECT o_custkey AS id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS tl, epoch(o_orderdate - TIMESTAMP '1996-01-01') / 86400.0 * 900 AS t,
   CASE o_orderstatus WHEN 'O' THEN 's' WHEN 'F' THEN 'e' ELSE 'x' END AS kind FROM orders),
g AS (SELECT id, tl, min(CASE WHEN kind = 's' THEN t END) AS s, min(CASE WHEN kind = 'e' THEN t END) AS e, min(CASE WHEN kind = 'x' THEN t END) AS x FROM ev GROUP BY id, tl),
w AS (SELECT id, tl, coalesce(s, e) AS ts, coalesce(e, s) AS te, x AS tx FROM g WHERE coalesce(s, e) <= coalesce(e, s) AND coalesce(e, s) <= x),
f AS (SELECT "Id" AS id, ord, t, row_number() OVER (PARTITION BY "Id" ORDER BY t, ord) AS i, CASE WHEN label = 'view' THEN CAST(floor(k / 20) AS BIGINT) + 1 END AS own FROM drv),
n AS (SELECT w.id, tl, ts, arg_min(i, (abs(t - ts), i)) AS a, arg_min(i, (abs(t - te), i)) AS b, arg_min(i, (abs(t - tx), i)) AS c FROM w JOIN f ON f.id = w.id GROUP BY w.id, tl, ts),
l AS (SELECT n.*, coalesce((SELECT max(i) FROM f WHERE f.id = n.id AND f.own = n.tl AND f.i >= n.c), n.c) AS z FROM n WHERE a <= b AND b <= c),
p AS (SELECT f.id, f.ord, ts, tl, CASE WHEN i >= c THEN 'LeavingJunction' WHEN i = b THEN 'AtStopLine' WHEN i > b THEN 'InsideJunction' ELSE 'Approaching' END AS ph
  FROM f JOIN l ON l.id = f.id AND f.i >= l.a AND f.i <= l.z)
SELECT id AS "Id", ord, arg_max(ph, (ts, tl)) AS phase FROM p GROUP BY id, ord""",
)
def junction_phase(spark, sf):
    """Orders as light events of the user with the same number: phases around each light."""
    drive = _drive(spark, sf).withColumn("SimulationTime", F.col("t"))
    own = F.when(F.col("label") == "view", F.concat(F.lit("traffic light "), (F.floor(F.col("k") / 20) + 1).cast("string"))).otherwise("None")
    frames = _frames(drive.withColumn("SpacialEvent", own), "SpacialEvent")
    word = F.when(F.col("o_orderstatus") == "O", "Start traffic light ").when(F.col("o_orderstatus") == "F", "Traffic light ").otherwise("End traffic light ")
    events = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("Id"), F.lit("x").alias("Condition"), (D.days("o_orderdate", "1996-01-01") * 900).alias("SimulationTime"),
        F.concat(word, F.substring("o_orderpriority", 1, 1)).alias("Event_Name"),
    )
    windows = L.junction_windows(events).join(frames.select(*TRIP).distinct(), ["Id", "Condition"])
    out = L.junction_phase(frames, windows)
    return out.join(frames.select(*TRIP, S.SEQ, "ord"), [*TRIP, S.SEQ]).select("Id", "ord", F.col("TrafficLight_JunctionPhase").alias("phase"))


# conversations as speech of the user with the same number
_SPEECH_SQL = f"""{_TRIPS_SQL},
seg AS (SELECT conv_id AS id, turn AS ord, turn * 2.0 + 1 AS a, turn * 2.0 + CASE turn % 3 WHEN 0 THEN 4.5 ELSE 0.75 END AS b, text, role AS speaker FROM conversations),
sp AS (SELECT id, ord, least(a, b) - 0.05 AS l, greatest(a, b) + 0.05 AS r, least(a, b) AS s, text, speaker FROM seg),
f AS (SELECT "Id" AS id, ord AS fo, t / 86400 AS t FROM drv),
cov AS (SELECT f.id, fo, sp.ord FROM f JOIN sp ON f.id = sp.id AND f.t >= l AND f.t <= r),
lon AS (SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.id = sp.id AND cov.ord = sp.ord)),
mov AS (SELECT lon.id, arg_min(fo, (abs(f.t - s), f.t)) AS fo, lon.ord FROM lon JOIN f ON f.id = lon.id GROUP BY lon.id, lon.ord),
hit AS (SELECT h.id, fo, h.ord, text, speaker FROM (SELECT * FROM cov UNION ALL SELECT id, fo, ord FROM mov) h JOIN sp ON sp.id = h.id AND sp.ord = h.ord),
fold AS (SELECT id, fo, string_agg(text, ' | ' ORDER BY ord) AS text, list_reduce(list(speaker ORDER BY ord), lambda x, y: CASE WHEN x = y THEN x ELSE x || ' | ' || y END) AS speaker FROM hit GROUP BY id, fo)"""


def _segments(spark, sf):
    c = D.table(spark, sf, "conversations")
    turn = F.col("turn")
    return c.select(
        F.col("conv_id").alias("Id"), F.lit("x").alias("Condition"), F.when(F.col("conv_id") % 2 == 0, "A").otherwise("C").alias("Map"),
        turn.alias("ord"), (turn * 2.0 + 1).alias("start"), (turn * 2.0 + F.when(turn % 3 == 0, 4.5).otherwise(0.75)).alias("end"),
        "text", F.col("role").alias("speaker"), F.lit("manual").alias("transcript_type"),
    )


@query(
    "transcript_attach",
    f"""WITH {_SPEECH_SQL}
SELECT f.id AS "Id", f.fo AS ord, fold.text, fold.speaker, CAST(fold.text IS NOT NULL AND trim(fold.text) <> '' AS INTEGER) AS comment_flag FROM f LEFT JOIN fold ON fold.id = f.id AND fold.fo = f.fo""",
)
def transcript_attach(spark, sf):
    """Whole conversation texts on the frames they cover, overlaps folded, lonely ones moved to the nearest frame."""
    frames = _frames(_drive(spark, sf).withColumn("SimulationTime", F.col("t") / 86400))
    out = P.attach_transcripts(frames, _segments(spark, sf))
    return out.select("Id", "ord", "text", "speaker", "comment_flag")


@query(
    "first_feedback",
    f"""WITH {_SPEECH_SQL},
st AS (SELECT DISTINCT x.id, arg_min(fo, (abs(f.t - a), f.t)) AS fo FROM (SELECT DISTINCT id, a FROM seg) x JOIN f ON f.id = x.id GROUP BY x.id, a),
j AS (SELECT d."Id" AS id, d.ord, d.t, d.label, CASE WHEN st.fo IS NOT NULL AND (fold.speaker IS NULL OR fold.speaker LIKE '%user%') THEN 1 ELSE 0 END AS hit
  FROM drv d LEFT JOIN st ON st.id = d."Id" AND st.fo = d.ord LEFT JOIN fold ON fold.id = d."Id" AND fold.fo = d.ord),
m AS (SELECT id, label, arg_min(ord, (t, ord)) AS first FROM j WHERE hit = 1 GROUP BY id, label)
SELECT j.id AS "Id", j.ord, CAST(j.ord = m.first AS INTEGER) AS first_feedback FROM j LEFT JOIN m ON m.id = j.id AND m.label = j.label""",
)
def first_feedback(spark, sf):
    """First comment of the accompanier (the user role) in each event of a trip."""
    frames = _frames(_drive(spark, sf).withColumn("SimulationTime", F.col("t") / 86400), "label")
    segments = _segments(spark, sf)
    said = materialize(P.attach_transcripts(frames, segments), "said")
    started = P.flag_comment_starts(said, segments)
    heard = F.when(F.col("speaker").contains("user"), "accompanier").otherwise(F.col("speaker"))
    out = P.flag_first_feedback(materialize(started.withColumn("speaker", heard), "started"), label="label", out="first_feedback")
    return out.select("Id", "ord", "first_feedback")
