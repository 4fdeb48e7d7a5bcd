"""End-to-end run over hand-made drives."""

import math

from pathlib import Path

import pytest

from drives import write_drives
from roadlens import schema as C
from roadlens.operators import windows as W
from roadlens.plans import dataset as D
from roadlens.plans import enrich as P
from roadlens.plans import validate as V
from roadlens.sources import logs


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return write_drives(tmp_path_factory.mktemp("drives") / "in put")


def _inputs(spark, paths):
    good, _ = logs.split_manifest(logs.read_manifest(spark, paths["manifest_csv"]))
    return P.read_inputs(spark, manifest=good, **{k: v for k, v in paths.items() if k != "manifest_csv"})


@pytest.fixture(scope="module")
def written(spark, paths, tmp_path_factory):
    """One whole run; the later tests look at what it wrote."""
    folder = tmp_path_factory.mktemp("results")
    out, bad = str(folder / "out"), str(folder / "failed")
    P.run(spark, output=out, failed=bad, **paths)
    # a second run finds all trips in the output and appends nothing; a broken file that no trip names is never opened
    before = spark.read.parquet(out).count(), spark.read.parquet(bad).count()
    Path(paths["ego_root"], "unrelated.json").write_bytes(b"\xff{{{ not json")
    P.run(spark, output=out, failed=bad, **paths)
    assert (spark.read.parquet(out).count(), spark.read.parquet(bad).count()) == before
    return out, bad


@pytest.fixture(scope="module")
def rows(spark, written):
    return spark.read.parquet(written[0]).select(*C.CANONICAL_COLUMNS).collect()


@pytest.fixture(scope="module")
def a(rows):
    """Frames of the first trip by tenth of a second."""
    return dict(sorted((round(r["SimulationTime"] * 10), r) for r in rows if r["Id"] == "C01"))


def test_shape(rows, a):
    assert {r["Id"] for r in rows} == {"C01", "C02"}
    assert len(a) == 401 and sum(r["Id"] == "C02" for r in rows) == 401
    assert a[400]["SpacialEvent"] == "Termination" and a[400]["Reason"] == "Collided-wall"
    assert a[5]["Acceleration"] == 5.0 and a[5]["Speed"] == 36.0 and a[5]["FrameID"] == 10


def test_interval_flags(a):
    assert [k for k, r in a.items() if r["Braking"] == 1] == list(range(10, 16))
    # the unrounded time 1.21 counts, so frame 12 is in
    assert [k for k, r in a.items() if r["Accelerating"] == 1] == list(range(12, 20))
    assert not any(r["TurnLeft"] or r["TurnRight"] for r in a.values())


def test_events(a):
    assert a[0]["SpacialEvent"] == "StartPoint" and a[0]["event_category"] == "SimulationPoints"
    assert a[1]["SpacialEvent"] == "None" and a[1]["time_since_event_start_world"] is None
    assert a[20]["SpacialEvent"] == "Start traffic light 1" and a[20]["BaseEvent"] == "traffic light 1"
    # inside the pair every label is replaced by the base event
    assert all(a[k]["SpacialEvent"] == "traffic light 1" for k in range(21, 70))
    assert a[70]["SpacialEvent"] == "End traffic light 1" and a[71]["SpacialEvent"] == "None"
    assert a[45]["time_since_event_start_world"] == pytest.approx(2.5)
    # the overtake never ends; the collision tail carries it to the termination
    assert all(a[k]["SpacialEvent"] == "overtake car" and a[k]["event_category"] == "Overtake" for k in range(301, 400))
    assert a[399]["time_since_event_start_world"] == pytest.approx(9.9)


def test_synthetic_start(rows):
    b = {round(r["SimulationTime"] * 10): r for r in rows if r["Id"] == "C02"}
    # delays of the others: C01 2.0, C07 2.0, C08 3.0, C09 3.0 -> median 2.5
    assert b[25]["SpacialEvent"] == "Start traffic light 1"
    assert b[26]["SpacialEvent"] == "traffic light 1" and b[24]["SpacialEvent"] == "None"


def _hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def test_distances(a):
    r = a[30]
    assert r["relevant_object_name"] == "traffic.traffic_light 60"
    assert r["distance_from_relevant_object"] == pytest.approx(_hav(r["Latitude"], r["Longitude"], 31.0, 34.0011), rel=1e-9)
    assert a[100]["relevant_object_name"] == "walker.pedestrian.0002 253"  # back-filled label
    assert a[75]["relevant_object_name"] is None
    # two candidates on map A: only cars whose longitude is at most the ego's count
    g = a[230]
    ahead = [n for n, px in (("vehicle.car 1", 500 - 230), ("vehicle.car 2", 460 - 230)) if 34.0 + px / 1e5 <= g["Longitude"]]
    assert (g["relevant_object_name"] is None) == (not ahead)


def test_overtake_phases(a):
    got = {k: r["Overtake"] for k, r in a.items() if r["Overtake"]}
    # v = 30 - 20 (t - 31): a drop of 5 within 5 samples first at 30.8, below 0.5 at 32.5
    assert got == {0: "start drive", 308: "start brake", 325: "stop", 340: "restart drive"}


def test_pedestrian(a):
    marks = {k: r["Pedestrian"] for k, r in a.items() if r["Pedestrian"]}
    assert marks == {100: "start walking", 110: "start crossing", 130: "end crossing"}
    assert all(a[k]["SpacialEvent"] == "section walker2" and a[k]["event_category"] == "Pedestrians" for k in range(100, 110))
    assert a[105]["time_since_event_start_world"] == pytest.approx(0.5)
    # crossing line is x = 125 from y = -3 to y = 3; the ego car drives along y = 0 at 10 m/s
    r = a[120]
    assert r["time_to_critical_point"] == pytest.approx(abs(125 - r["PositionX"]) / 10, rel=1e-6)


def test_lights(a):
    assert {k: a[k]["TrafficLight"] for k in (20, 29, 30, 69, 70)} == {20: "Yellow", 29: "Yellow", 30: "Red", 69: "Red", 70: "Red"}
    phases = {k: r["TrafficLight_JunctionPhase"] for k, r in a.items() if r["TrafficLight_JunctionPhase"]}
    assert phases[20] == "Approaching" and phases[49] == "Approaching" and phases[50] == "AtStopLine"
    assert phases[51] == phases[69] == "InsideJunction" and phases[70] == "LeavingJunction"
    assert set(phases) == set(range(20, 71))


def test_gaps(a):
    near = {k: r for k, r in a.items() if r["relevant_object_name"] == "vehicle.car 1" and 200 <= k <= 290}
    assert near
    for k, r in near.items():
        t = k / 10
        one = 36.0 * t
        two = 39.6 * (math.floor((t - 0.02 + 1e-9) * 10) / 10)
        assert r["gap_acceptance"] == pytest.approx(abs(two - one), abs=1e-6)
    # the last vehicle of the line has no follower
    assert all(r["gap_acceptance"] is None for r in a.values() if r["relevant_object_name"] == "vehicle.car 2")


def test_ttc(a):
    r = a[230]  # gap event, moving, no stop inside it: police car until the overtake begins
    assert r["ttc_object_name"] == "vehicle.dodge.charger_police 12"
    assert r["time_to_collision"] == pytest.approx((400 - r["PositionX"]) / 10)
    # walker 4 m ahead, both moving: |(4 - 10 s, 3 s)| = 2
    assert a[120]["ttc_object_name"] == "walker.pedestrian.0002 253"
    assert a[120]["time_to_collision"] == pytest.approx((80 - math.sqrt(6400 - 5232)) / 218)
    assert a[60]["time_to_collision"] is None  # inside the junction
    g = a[40]
    assert g["time_to_collision"] == pytest.approx(g["distance_from_relevant_object"] / 10)
    assert a[160]["Speed"] == 0.0 and a[160]["time_to_collision"] is None


def test_speech(a):
    assert a[30]["text"] == "slow, please" and a[30]["speaker"] == "accompanier" and a[30]["transcript_type"] == "manual"
    assert a[32]["text"] == "slow, please | ok | good"
    assert a[32]["speaker"] == "accompanier | driver | accompanier"
    assert a[33]["text"] == "ok" and a[34]["text"] is None and a[34]["comment_flag"] == 0
    assert a[124]["text"] == "look" and a[124]["speaker"] is None  # reversed ends
    assert a[400]["text"] == "the end"  # beyond the last frame
    assert {k for k, r in a.items() if r["start_comment"] == 1} == {30, 31, 125, 400}
    assert a[30]["first_feedback_in_event"] == 1 and a[31]["first_feedback_in_event"] == 0
    assert a[125]["first_feedback_in_event"] == 1 and a[1]["first_feedback_in_event"] is None


def test_small_chunks_give_the_same_rows(spark, paths, rows):
    again = P.enrich(_inputs(spark, paths), chunk_bits=4).collect()

    def plain(rs):
        return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rs)

    assert plain(again) == plain(rows)


def test_failures_and_resume(spark, paths, written):
    out, bad = written
    failed = {(r["Id"], r["FailedStep"]) for r in spark.read.parquet(bad).collect()}
    assert failed == {("C04", "KinematicFile"), ("C03", "frames")}
    good, _ = logs.split_manifest(logs.read_manifest(spark, paths["manifest_csv"]))
    assert [r["Id"] for r in logs.pending(good, spark.read.parquet(out)).collect()] == ["C03"]
    only, _ = logs.split_manifest(logs.read_manifest(spark, paths["manifest_csv"]), only_ids=["C02"])
    assert [r["Id"] for r in only.collect()] == ["C02"]


def test_window_dataset(spark, written):
    frames = spark.read.parquet(written[0])
    win = D.build_windows(frames, sizes=(1.0, 2.0)).cache()
    ones = {r["window_index"]: r for r in win.where("window_size_sec = 1 and Id = 'C01'").collect()}
    # the event runs from 2.0 s to 7.0 s, feedback at its second 1.0, on the edge of windows 0 and 1
    assert set(ones) == {0} and ones[0]["event_id"] == "c01__avatar__traffic light 1"
    assert ones[0][W.FEEDBACK] == 1 and ones[0]["TrafficLight_current"] == "Yellow" and ones[0]["current_phase"] == "Approaching"
    other = win.where("window_size_sec = 2 and Id = 'C02'").orderBy("window_index").collect()
    assert [r["window_index"] for r in other] == [0, 1, 2] and other[0]["yellow_transition"] == 0
    table = D.model_table(win.where("window_size_sec = 1"))
    assert {r["segment"] for r in table.where("Id = 'C02'").select("segment").collect()} <= {1, 2, 3, None}
    assert table.where("TTC_imputed > 6").count() == 0


def test_validation_report(spark, written):
    rows = {r["check_id"]: r for r in V.report(spark.read.parquet(written[0])).collect()}
    assert len(rows) == len(V.checks()) + 13
    bad = {k for k, r in rows.items() if r["status"] == "FAIL"}
    assert bad == set(), {k: (rows[k]["n_rows_failed"], rows[k]["example_failing_rows"]) for k in bad}
    assert rows["Speed.range"]["n_rows_checked"] == 802 and rows["BaseEvent.recomputed"]["status"] == "PASS"
