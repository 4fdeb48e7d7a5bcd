"""Quality checks, ragged files, readers and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from roadlens import schema as C
from roadlens.functions import geometry as G
from roadlens.functions import numeric as N
from roadlens.functions import text as T
from roadlens.operators import collision as K
from roadlens.operators import events as E
from roadlens.operators import quality as Q
from roadlens.operators import scan as S
from roadlens.session import materialize
from roadlens.sources import logs, sinks


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "fn,given,want",
    [
        (T.clean_event, "Egocar Start gap acceptance", "egocar gap acceptance"),
        (T.clean_event, "StartPoint", "StartPoint"),
        (T.clean_event, " End  traffic-light 3 ", "trafficlight 3"),
        (T.feedback_event, "Egocar start Gap", "gap"),
        (T.normalize_type, " Car Telemetries", "Car_Telemetries"),
        (T.normalize_type, "Other", "Other"),
        (T.normalize_walker, "Pedestrian 3", "section walker3"),
        (T.normalize_walker, "Start section walker2", "Start section walker2"),
        (T.categorize, "start Section walker2", "Pedestrians"),
        (T.light_event_kind, "Traffic light 10", "entry"),
        (T.light_number, "End traffic light 10", 10),
        (T.light_number, "walker 1", None),
        (T.comment_flag, "  ", 0),
        (N.clock_seconds, "1 days 00:01:02.5", 86462.5),
        (N.clock_seconds, "nonsense", None),
        (N.number, "NaN", None),
        (N.number, "1e3", 1000.0),
    ],
)
def test_rules(spark, fn, given, want):
    assert _one(spark, fn(F.lit(given))) == want


def test_rounding_is_half_even(spark):
    assert [_one(spark, N.decisecond(F.lit(v))) for v in (0.25, 0.35, 1.05, -0.25)] == [2, 4, 10, -2]


def _ttc(spark, fn, *args):
    return _one(spark, fn(*[F.lit(float(a)) for a in args]))


def test_collision_limits(spark):
    assert _ttc(spark, G.ttc_static, 0, 0, 36, 0, 0, 0) == 0.0
    assert _ttc(spark, G.ttc_static, 0, 0, 36, 0, 50, 0) == pytest.approx(5.0)
    assert _ttc(spark, G.ttc_static, 0, 0, 36, 180, 50, 0) is None
    assert _ttc(spark, G.ttc_static, 0, 0, 1.8, 0, 50, 0) is None  # closing at exactly 0.5 m/s
    assert _ttc(spark, G.ttc_range_rate, 0, 0, 36, 0, 50, 0, -15, 0) == pytest.approx(2.0)
    assert _ttc(spark, G.ttc_quadratic, 0, 0, 36, 0, 1, 1, 0, 0) == 0.0
    assert _ttc(spark, G.ttc_quadratic, 0, 0, 36, 0, 12, 0, 0, 0) == pytest.approx(1.0)
    assert _ttc(spark, G.ttc_quadratic, 0, 0, 36, 0, 12, 5, 0, 0) is None
    assert _ttc(spark, G.ttc_quadratic, 0, 0, 0, 0, 12, 5, 0, 0) is None
    assert _ttc(spark, G.line_distance, 3, 4, 0, 0, 0, 0) == 5.0
    assert _ttc(spark, G.signed_line_distance, 1, 2, 0, 0, 1, 0) == 2.0
    assert _ttc(spark, G.ttc_generic, 10, 36) == pytest.approx(1.0)
    assert _ttc(spark, G.ttc_generic, 10, 1.8) is None


def test_checks(spark):
    df = spark.createDataFrame(
        [(1, "Avatar", 0, "a", None), (2, "avatar", 2, None, "t"), (3, "Avatar", None, "a", "u"), (4, None, 1, "nan", None)],
        "id long, Condition string, flag int, x string, y string",
    )
    rows = {
        r["check_id"]: (r["status"], r["n_rows_checked"], r["n_rows_failed"], r["example_failing_rows"])
        for r in Q.run_checks(
            df,
            [Q.check_enum("Condition", ["Avatar", "Remote"], bad="WARN"), Q.check_binary("flag"), Q.check_iff("x", "y"), Q.check_implies("x", "y"),
             Q.check_only_where("y", F.col("flag") == 2, "flag2"), Q.check_literal_null("x"), Q.check_format("Condition", "^[Aa]vatar$"), Q.check_range("flag", 0, 2)],
            "id",
        ).collect()
    }
    assert rows["Condition.enum"] == ("WARN", 3, 1, "2")
    assert rows["flag.binary"] == ("FAIL", 4, 2, "2, 3")
    assert rows["x.iff.y"] == ("FAIL", 4, 3, "1, 2, 4")
    assert rows["x.implies.y"] == ("FAIL", 3, 2, "1, 4")
    assert rows["y.only.flag2"] == ("FAIL", 2, 1, "3")
    assert rows["x.hygiene"] == ("FAIL", 3, 1, "4")
    assert rows["Condition.format"] == ("PASS", 3, 0, "") and rows["flag.range"] == ("PASS", 3, 0, "")
    variants = Q.check_variants(df, "Condition").first()
    assert (variants["n_rows_checked"], variants["n_rows_failed"]) == (3, 3)


def test_recomputed_columns_and_phase_order(spark):
    df = spark.createDataFrame(
        [(1, "k", "Start traffic light 1", "traffic light 1", "hi", 1, "Approaching"), (2, "k", "Walker 2", "stale", " ", 0, "InsideJunction"), (3, "k", "None", "None", None, 1, "Approaching")],
        "id long, k string, SpacialEvent string, BaseEvent string, text string, comment_flag int, phase string",
    )
    rows = {r["check_id"]: r["example_failing_rows"] for r in Q.run_checks(df, [Q.check_base_event(), Q.check_comment_flag()], "id").collect()}
    assert rows == {"BaseEvent.recomputed": "2", "comment_flag.recomputed": "3"}
    seq = S.sequence(df, ["k"], ["id"])
    r = Q.check_phase_order(seq, ["k"], "phase", ["Approaching", "AtStopLine", "InsideJunction"]).first()
    assert (r["n_rows_checked"], r["n_rows_failed"]) == (2, 1)


def test_ragged(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('a,b,c\n1,"x, ""y""",3\n1,2\n1,,A,4\n', encoding="utf-8")
    ragged = Q.read_ragged(spark.createDataFrame([("ragged.csv",)], "file string"), str(tmp_path))
    assert {r["n_fields"]: (r["n_rows"], r["kind"]) for r in Q.field_counts(ragged, 3).collect()} == {3: (2, "ok"), 2: (1, "short"), 4: (1, "long")}
    rows = [tuple(r) for r in Q.pad_fields(ragged, ["a", "b", "c"]).collect()]
    assert (3, "1", 'x, "y"', "3") in rows and (2, "1", "2", None) in rows and (4, "1", "", "A") in rows
    report = Q.check_structural(ragged, ["a", "b", "c"], "c", "^[A-Z]$")
    got = {r["check_id"]: (r["n_rows_checked"], r["n_rows_failed"], r["example_failing_rows"]) for r in report.collect()}
    assert got == {"fields.count": (4, 2, "2, 3"), "fields.shifted": (4, 1, "3"), "fields.surplus": (1, 1, "3")}


def _records(spark, tmp_path, name, data):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "log.json").write_text(json.dumps(data), encoding="utf-8")
    trips = spark.createDataFrame([("C1", "x", "A", "log.json")], "Id string, Condition string, Map string, f string")
    return logs.read_records(spark, str(folder), C.EGO_RECORD, trips, "f")


def test_records_without_type_and_number(spark, tmp_path):
    data = [{"SimulationTime": i // 2 * 0.1, "Speed": i, "Latitude": 1.0} for i in range(6)]
    ego = logs.ego_records(_records(spark, tmp_path, "plain", data)).orderBy("ord").collect()
    assert [r["Type"] for r in ego] == ["GPS", "Car_Telemetries"] * 3 and [r["FrameID"] for r in ego] == list(range(6))
    frames = logs.build_frames(_records(spark, tmp_path, "again", {"Logs": data}))
    # numbers never coincide, parities differ, telemetry is one ahead
    assert sorted((r["FrameID"], r["Speed"]) for r in frames.collect()) == [(0, 1.0), (2, 3.0), (4, 5.0)]


@pytest.mark.parametrize("gps,tele,want", [([0, 2], [1, 3], {0: 1, 2: 3}), ([1, 5], [0, 4], {1: 0, 5: 4}), ([0, 1], [1, 2], {1: 1}), ([0, 4], [2, 6], {}), ([0, 2], [5, 7], {})])
def test_pairing(spark, gps, tele, want):
    g = spark.createDataFrame([("t", i) for i in gps], "k string, FrameID long")
    t = spark.createDataFrame([("t", i, i) for i in tele], "k string, FrameID long, tele long")
    assert {r["FrameID"]: r["tele"] for r in logs.pair_frames(g, t, ["k"]).collect()} == want


def test_canonical_sink(spark, tmp_path):
    df = spark.createDataFrame([("C1", "x", "A", 1.5, 7)], "Id string, Condition string, Map string, Speed double, extra int")
    sinks.append_frames(df, str(tmp_path / "out"))
    sinks.append_frames(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2 and set(back.columns) == set(C.CANONICAL_COLUMNS)
    sinks.append_frames(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    sinks.append_failures(spark.createDataFrame([(" C1 ", 5)], "Id string, ErrorMessage int"), str(tmp_path / "bad"))
    assert tuple(spark.read.parquet(str(tmp_path / "bad")).first()) == ("C1", "", "", "", "5")
    sinks.write_windows({1.0: df.select("Id"), 2.0: df.select("Id", "Speed")}, str(tmp_path / "win"))
    assert spark.read.parquet(str(tmp_path / "win")).groupBy("window_size_sec").count().count() == 2


def test_missing_columns_are_an_error(spark, tmp_path):
    (tmp_path / "k.csv").write_text("Id,Condition\n1,2\n")
    with pytest.raises(ValueError, match="triggered_by"):
        logs.read_kinematic(spark, str(tmp_path / "k.csv"))


@pytest.mark.parametrize("bits", [1, 18])
def test_run_elapsed_and_tail(spark, bits):
    rows = [("t", i, lab) for i, lab in enumerate(["a", "a", "None", "a", "b", "b", " ", "b"])]
    seq = S.sequence(spark.createDataFrame(rows, "k string, t long, lab string"), ["k"], ["t"], bits)
    got = [r["time_since_event_start_world"] for r in E.run_elapsed(seq, keys=["k"], clock="t", label="lab").orderBy("t").collect()]
    assert got == [0, 1, None, 0, 0, 1, None, 0]
    rows = [("t", 0, "Start x", None), ("t", 1, "None", None), ("t", 2, "Termination", "left"), ("t", 3, "None", None), ("t", 4, "Termination", "COLLIDED-car"),
            ("t", 5, "None", None), ("u", 0, "Termination", "collided-x"), ("u", 1, "None", None)]
    seq = S.sequence(spark.createDataFrame([(k, i, lab, lab, why) for k, i, lab, why in rows], "Id string, t long, SpacialEvent string, BaseEvent string, Reason string"), ["Id"], ["t"], bits)
    out = {(r["Id"], r["t"]): r["SpacialEvent"] for r in E.fill_collision_tail(seq, keys=["Id"]).collect()}
    assert out[("t", 1)] == "x" and out[("t", 2)] == "Termination" and out[("t", 3)] == "x" and out[("t", 5)] == "None" and out[("u", 1)] == "None"


def test_later_pair_wins_and_ends_stay(spark):
    f = S.sequence(spark.createDataFrame([("t", float(i), "n") for i in range(8)], "k string, t double, lab string"), ["k"], ["t"], 1)
    pairs = spark.createDataFrame([("t", 0.0, 5.0, "one", 1), ("t", 3.0, 7.0, "two", 2), ("t", 6.0, 2.0, "backwards", 3)], "k string, _from double, _to double, _pair string, _rank int")
    got = [r["lab"] for r in E.fill_between(f, pairs, keys=["k"], at="t", label="lab").orderBy("t").collect()]
    assert got == ["n", "one", "one", "one", "two", "two", "two", "n"]


def test_own_gaps_are_the_rows_of_the_gap_table_that_frames_use(spark):
    r = random.Random(12)
    names = [f"car {i}" for i in range(6)]
    tracks = spark.createDataFrame(
        [("a", "c", m, n, float(t) + i / 10, float(t) + i / 10, r.uniform(0, 50), t) for m in "AB" for i, n in enumerate(names) for t in range(8)],
        "Id string, Condition string, Map string, Name string, SimulationTime double, _world double, Speed double, ord long",
    )
    rows = []
    for m in "AB":
        for t in range(0, 90, 3):
            own = r.choice([*names, None, "car 0, car 3", "bus"])
            rows.append(("a", "c", m, t / 10, r.choice(["Egocar gap acceptance", "gap acceptance", "Egocar gap acceptance", "other"]), own))
    frames = spark.createDataFrame(rows, "Id string, Condition string, Map string, SimulationTime double, SpacialEvent string, relevant_object_name string")
    whole, own = (materialize(f(frames, tracks)) for f in (K.gap_table, K.own_gaps))
    assert own.join(whole, own.columns, "left_anti").count() == 0
    key = lambda df: sorted(map(repr, K.attach_gaps(frames, df).collect()))
    assert key(own) == key(whole) and own.where("GapAcceptance is not null").count() > 5
    gap = frames.where(K.is_gap_frame(F.col("Map"), F.col("SpacialEvent")))
    assert own.count() <= gap.count() < whole.count()


def test_profile_reads_everything_once(spark):
    rows = [(i, float(i % 500) if i % 10 else None, f"t{i % 37}", [i % 3]) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, v double, name string, list array<long>")
    got = {r["column_name"]: r for r in logs.profile(df, order=["id"]).collect()}
    assert [got[c]["nulls"] for c in ("id", "v", "name", "list")] == [0, 500, 0, 0] and {r["rows"] for r in got.values()} == {5000}
    for c, n in (("id", 5000), ("v", 450), ("name", 37), ("list", 3)):
        assert abs(got[c]["distinct_estimate"] - n) <= 0.06 * n
    known = sorted(v for _, v, _, _ in rows if v is not None)
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(sum(v <= got["v"][q] for v in known) / len(known) - p) < 0.01
    assert (got["name"]["first"], got["name"]["last"], got["name"]["mean"]) == ("t0", f"t{4999 % 37}", None)
    empty = {r["column_name"]: r for r in logs.profile(df.limit(0)).collect()}
    assert empty["v"]["rows"] == 0 and empty["v"]["distinct_estimate"] == 0 and empty["v"]["first"] is None
    ends = logs.head_and_tail(df, ["id"], 2).collect()
    assert sorted((r["part"], r["id"]) for r in ends) == [("head", 0), ("head", 1), ("tail", 4998), ("tail", 4999)]
