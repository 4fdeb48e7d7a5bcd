"""Window rules on hand-made events."""

import math

import pytest
from pyspark.sql import functions as F

from roadlens.operators import windows as W

_COLS = (
    "event_id string, ord long, t double, Speed double, Brake double, Acceleration double, SteeringAngle double, "
    "distance_from_relevant_object double, relevant_object_name string, time_to_collision double, TrafficLight string, "
    "TrafficLight_JunctionPhase string, Id string, Condition string, Map string, event_category string"
)


def _frame(event, o, t, speed=1.0, dist=None, name=None, ttc=None, light=None, phase=None, brake=0.0):
    return (event, o, t, speed, brake, 0.5, -0.2, dist, name, ttc, light, phase, "C1", "Avatar", "A", "TrafficLights")


def test_edges_and_empty_windows(spark):
    rows = [_frame("e", i, t) for i, t in enumerate([0.5, 0.9, 1.4999, 3.6, 4.5])]
    got = {
        r["window_index"]: (r["start_time"], r["end_time"], r["is_partial_window"], r["max_time_since_event_start"])
        for r in W.window_features(spark.createDataFrame(rows, _COLS), size=1.0, at="t", order="ord").collect()
    }
    # the row exactly at the end (4.5 = 0.5 + 4) belongs to no window; windows 1 and 2 are empty
    assert got == {0: (0.5, 1.5, 0, 1.4999), 3: (3.5, 4.5, 0, 3.6)}


def test_features_by_rule(spark):
    rows = [
        _frame("e", 0, 0.0, speed=4.0, dist=9.0, name="b", ttc=None, light=None, phase=None),
        _frame("e", 1, 0.1, speed=0.0, dist=None, name="b", ttc=float("inf"), light="Yellow", phase=None, brake=1.0),
        _frame("e", 2, 0.2, speed=1.0, dist=7.5, name="a", ttc=3.0, light="Red", phase=None),
        _frame("e", 3, 0.3, speed=1.0, dist=8.0, name="a", ttc=2.5, light=None, phase=None),
        _frame("e", 4, 1.5, speed=0.1, light="Yellow", phase="Approaching"),
        _frame("e", 5, 1.7, speed=0.2, light="Yellow", phase="InsideJunction"),
        _frame("e", 6, 2.2, speed=0.2),
    ]
    out = {r["window_index"]: r for r in W.window_features(spark.createDataFrame(rows, _COLS), size=1.0, at="t", order="ord").collect()}
    a, b = out[0], out[1]
    assert a["relevant_object_name"] == "a"  # two of each: the smaller name
    assert a["delta_distance"] == 1.0 and a["min_distance_from_relevant_object"] == 7.5
    assert a["Braking_rate"] == 0.25 and a["Speed_delta"] == -3.0 and a["Speed_mean"] == 1.5
    assert a["TTC_min"] == 2.5 and a["TTC_delta"] == -0.5
    assert a["TrafficLight_prev"] is None and a["TrafficLight_current"] is None and a["yellow_transition"] == 1
    assert a["transition_phase"] == 1  # unknown to unknown counts
    assert b["yellow_transition"] == 0 and b["transition_phase"] == 1 and b["is_stopped"] == 1
    assert b["TTC_min"] is None and b["TTC_delta"] is None and b["relevant_object_name"] is None
    assert b["Speed_std"] == pytest.approx(math.sqrt(0.005)) and out[2]["is_partial_window"] == 1 if 2 in out else True


def test_mean_speed_is_summed_in_record_order(spark):
    # sums of these speeds depend on their order
    speeds = next(v for i in range(1, 500) for v in [(i / 7 % 18, 18.1, 35.9 - i / 7 % 18)] if (v[0] + v[1] + v[2]) / 3 != (v[2] + v[1] + v[0]) / 3)
    rows = [_frame("e", i, 0.1 * i, speed=v) for i, v in enumerate(speeds)] + [_frame("e", 3, 2.0, speed=0.0)]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        frames = spark.createDataFrame(some, _COLS)
        for df in (frames.coalesce(1), frames.repartition(3)):
            got = W.window_features(df, size=1.0, at="t", order="ord").where("window_index = 0").first()
            assert got["Speed_mean"] == ((speeds[0] + speeds[1]) + speeds[2]) / 3


def test_window_times_are_rounded_as_in_sql(spark):
    import duckdb

    # first events 5 in the fifth decimal of an hour: whether a later window's start is a tie depends on its scaled double
    first = [(360000 * m + 180000) / 1e6 / 3600 for m in range(60)]
    rows = [_frame(f"e{m}", 100 * m + k, t + 24.0 * k) for m, t in enumerate(first) for k in range(31)]
    out = W.window_features(spark.createDataFrame(rows, _COLS), size=24.0, at="t", order="ord").select("event_id", "window_index", "start_time", "end_time").collect()
    begin = {(r.event_id, r.window_index): first[int(r.event_id[1:])] + r.window_index * 24.0 for r in out}
    want = duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda b: round_even(b, 4))", [list(begin.values())]).fetchone()[0]
    assert len(out) >= 60 * 30 and [r.start_time for r in out] == want


def test_targets(spark):
    win = spark.createDataFrame([("e", i, float(i), i + 1.0) for i in range(5)] + [("f", 0, 0.0, 1.0)], "event_id string, window_index long, start_time double, end_time double")
    fb = spark.createDataFrame([("e", 3.0), ("e", 4.2)], "event_id string, feedback_at double")
    got = {(r["event_id"], r["window_index"]): (r[W.FEEDBACK], r["feedback_next_1s"]) for r in W.window_targets(win, fb).collect()}
    # 3.0 is on the edge of windows 2 and 3; the first of them ends the event
    assert got == {("e", 0): (0, 0), ("e", 1): (0, 1), ("e", 2): (1, 0), ("f", 0): (0, 0)}


_SEG = "event_id string, start_time double, current_phase string, TrafficLight_current string, yellow_transition int, is_stopped int"


def _segments(spark, rows):
    df = spark.createDataFrame([("e", float(i), *r) for i, r in enumerate(rows)], _SEG)
    return [r["segment"] for r in W.assign_segments(df).orderBy("start_time").collect()]


A, J, L, STOP = "Approaching", "InsideJunction", "LeavingJunction", "AtStopLine"


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(A, "Green", 0, 0), (STOP, "Green", 0, 0), (J, "Green", 0, 0), (L, "Green", 0, 0)], [1, None, 3, 3]),
        ([(A, "Green", 0, 0), (A, "Yellow", 1, 0), (A, "Red", 0, 0)], [1, 2, 2]),
        ([(A, "Green", 0, 0), (A, "Yellow", 1, 0), (A, "Red", 0, 1), (A, "Green", 0, 0), (J, "Green", 0, 0)], [1, 2, 2, 3, 3]),
        ([(A, "Green", 0, 0), (A, "Yellow", 1, 0), (J, "Red", 0, 0), (J, "Red", 0, 1), (L, "Green", 0, 0)], [1, 2, 2, 2, 3]),
        ([(A, "Green", 0, 0), (A, "Yellow", 1, 0), (J, "Yellow", 0, 0), (L, "Red", 0, 0)], [1, 2, 2, 2]),
        # stopped inside before the yellow: everything after the stop is segment 3
        ([(A, "Green", 0, 0), (J, "Red", 0, 1), (A, "Red", 0, 0), (A, "Yellow", 1, 0)], [1, None, 3, 3]),
    ],
)
def test_segments(spark, rows, want):
    assert _segments(spark, rows) == want


@pytest.mark.parametrize("bits", [1, 18])
def test_n_row_windows(spark, bits):
    rows = [("e", i, float(i), i + 1.0, float(i * i), int(i in (5, 6))) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id string, window_index long, start_time double, end_time double, Speed_mean double, feedback_next_1s int")
    got = {r["window_index"]: (r["start_time"], r["end_time"], r["Speed_mean"], r["Speed_delta"], r["feedback_next"]) for r in W.n_row_windows(df, n=3, horizon=2, chunk_bits=bits).collect()}
    assert got == {0: (0.0, 3.0, 5 / 3, 4.0, 0), 1: (3.0, 6.0, 50 / 3, 16.0, 1)}


def test_horizon_windows_against_loop(spark):
    starts = {"e": [0, 1, 2, 3, 5, 6], "f": [2.5, 3.5, 4.5]}
    hits = {("e", 5), ("f", 4.5)}
    rows = [(e, float(s), 2.0 * s, int((e, s) in hits)) for e, ss in starts.items() for s in ss]
    df = spark.createDataFrame(rows, "event_id string, start_time double, v double, hit int")
    got = {
        (r["event_id"], r["win"], r["horizon"], r["window_no"]): (r["v"], r["target"])
        for r in W.horizon_windows(df, sizes=[1, 2, 3], horizons=[1, 2, 4], features={"v": ("v", "mean")}, hit="hit").collect()
    }
    want = {}
    for e, ss in starts.items():
        for w in (1, 2, 3):
            for h in (1, 2, 4):
                t, k = min(ss), 0
                while t + w <= max(ss) + 1:
                    inside = [s for s in ss if t <= s < t + w]
                    if inside:
                        told = any((e, s) in hits for s in ss if t + w <= s < t + w + h)
                        want[(e, w, h, k)] = (sum(2.0 * s for s in inside) / len(inside), int(told))
                    t, k = t + w, k + 1
    assert got == want


def test_impute(spark):
    df = spark.createDataFrame(
        [("a", 1, None, None, 1.0, 2.0, None), ("b", 0, None, "Inside", None, 4.0, None), (None, 0, None, None, 100.0, 100.0, 5.0), ("c", 0, "X", None, 3.0, None, 5.0)],
        "relevant_object_name string, is_partial_window int, prev_phase string, current_phase string, Acceleration_max double, min_distance_from_relevant_object double, TTC_min double",
    )
    out = {r["relevant_object_name"]: r for r in W.impute(df, medians=["Acceleration_max"]).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"]["prev_phase"] == "Approaching" and out["b"]["prev_phase"] == "LeavingJunction" and out["c"]["current_phase"] == "LeavingJunction"
    assert out["b"]["Acceleration_max"] == 2.0 and out["c"]["min_distance_from_relevant_object"] == 3.0
    assert out["a"]["TTC_min"] is None
    filled = W.impute(df, medians=["Acceleration_max"], ttc_fill=W.TTC_FILL)
    assert filled.where("TTC_min = 999").count() == 2
    report = {r["column_name"]: (r["nulls_before"], r["nulls_after"]) for r in W.null_report(df, filled).collect()}
    assert report["TTC_min"] == (2, 0) and report["relevant_object_name"] == (1, 0)


def test_event_table_uses_first_nonnull_per_column(spark):
    df = spark.createDataFrame(
        [("e", 1.0, None, 1, 0, "Red", None, "Avatar", "A"), ("e", 2.0, 4.0, 1, 0, "Red", "C1", "Avatar", "A"), ("e", 3.0, 1.0, 0, 1, "Green", "C1", "Avatar", "A"), ("f", 1.0, 1.0, 0, 1, "Red", "C2", "Avatar", "A")],
        f"event_id string, start_time double, TTC_min double, yellow_transition int, {W.FEEDBACK} int, TrafficLight_current string, Id string, Condition string, Map string",
    )
    rows = W.event_table(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["Id"], r["TTC_min_at_yellow"], r["yellow_start_time"], r["feedback_time"], r["time_to_feedback"]) == ("C1", 4.0, 1.0, 3.0, 2.0)
    assert r["TrafficLight_at_feedback"] == "Green"


def test_short_events_and_one_hot(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("b", 0), ("c", 0), ("c", 0), ("c", 0), ("d", 0), ("d", 1)], "event_id string, feedback_next_1s int")
    assert {r["event_id"] for r in W.drop_short_events(df).collect()} == {"c", "d"}
    train = spark.createDataFrame([("x",), ("y",)], "p string")
    test = spark.createDataFrame([("y",), ("z",), (None,)], "p string")
    assert [tuple(r) for r in W.one_hot(test, W.categories(train, ["p"])).collect()] == [(0, 1), (0, 0), (0, 0)]
