"""Hand-made drives on disk: two good trips, one trip with unusable files, one without a file name."""

import csv
import json


def _clock(t):
    return f"10:{int(t // 60):02d}:{t % 60:06.3f}"


def _ego(offset, n=400):
    """Ten frames a second eastwards at 36 km/h (10 m/s), standing still from 15 s to 18 s."""
    logs = []
    x = 0.0
    for i in range(n):
        t = i / 10
        speed = 0.0 if 15 <= t < 18 else 36.0
        x += speed / 36.0
        fid = 2 * i
        logs.append({
            "Type": "gps" if i % 2 else "GPS", "FrameID": fid, "WorldTime": _clock(t), "SimulationTime": t + 0.01,
            "Longitude": 34.0 + x / 100000, "Latitude": 31.0 - (t - 25 if t > 25 else 0) / 1e5,
            "SimulationPosition": {"x": x, "y": 0.0, "z": 0.0}, "Orientation": {"x": 0, "y": 0.0, "z": 0},
            "Acceleration": {"x": 3.0, "y": None, "z": 4.0},
        })
        logs.append({"Type": "Car Telemetries", "FrameID": fid + offset, "Speed": speed, "SteeringAngle": 0.1 * (i % 5), "Brake": 0.0 if speed else 1.0})
    logs.append({"Type": "termination", "FrameID": 2 * n, "WorldTime": _clock(n / 10), "SimulationTime": n / 10 + 0.01, "Reason": "x"})
    return logs


def _objects():
    out = []
    for i in range(0, 401):
        t = i / 10
        state = None if t < 1 else "Yellow" if t < 3 else "Red" if t < 8 else "Green"
        out.append({"Name": "traffic.traffic_light 60", "SimulationTime": t, "WorldTime": _clock(t),
                    "SimulationPosition": {"x": 110.0, "y": 5.0}, "Latitude": 31.0, "Longitude": 34.0011, "Speed": 0,
                    "CurrentState": state, "PreviousState": "Green" if state == "Yellow" else None})
        out.append({"Name": "traffic.traffic_light 160", "SimulationTime": t, "WorldTime": _clock(t),
                    "SimulationPosition": {"x": 999.0, "y": 5.0}, "Latitude": 31.0, "Longitude": 34.1, "Speed": 0})
        out.append({"Name": "vehicle.dodge.charger_police 12", "SimulationTime": t, "WorldTime": _clock(t),
                    "SimulationPosition": {"x": 400.0, "y": 0.0}, "Latitude": 31.0, "Longitude": 34.004, "Speed": 0})
        for j, name in enumerate(("vehicle.car 1", "vehicle.car 2")):
            px = 500.0 - 10 * t - 40 * j
            out.append({"Name": name, "SimulationTime": t + 0.02 * j, "WorldTime": _clock(t + 0.5 * j),
                        "SimulationPosition": {"x": px, "y": 3.0}, "Latitude": 31.0, "Longitude": 34.0 + px / 100000,
                        "Speed": 36.0 + 3.6 * j})
        if 10 <= t <= 14:
            out.append({"Name": "walker.pedestrian.0002 253", "SimulationTime": t, "WorldTime": _clock(t),
                        "SimulationPosition": {"x": 125.0, "y": -6 + 3 * (t - 10)}, "Latitude": 31.0 + (-6 + 3 * (t - 10)) / 1e5,
                        "Longitude": 34.00125, "Speed": 10.8})
        v = 30.0 if t < 31 else max(0.0, 30 - 20 * (t - 31)) if t < 34 else 20.0
        out.append({"Name": "vehicle.lead 7", "SimulationTime": t, "WorldTime": _clock(t),
                    "SimulationPosition": {"x": 600.0 + t, "y": 0.0}, "Latitude": 31.0, "Longitude": 34.006, "Speed": v})
    return out


_EVENTS = [
    ("StartPoint", 0.0, "Start/End Simulation", ""), ("Start traffic light 1", 2.0, "Spacial", ""),
    ("Traffic light 1", 5.0, "Spacial", ""), ("End traffic light 1", 7.0, "Spacial", ""),
    ("Start section walker2", 11.0, "Spacial ", ""), ("End section walker2", 14.0, "Spacial", ""),
    ("Egocar Start gap acceptance", 20.0, "Spacial", ""), ("Egocar End gap acceptance", 29.0, "Spacial", ""),
    ("Start overtake car", 30.0, "Spacial", ""),
    ("Termination", 40.0, "Spacial", "Collided-wall"),
]


def write_drives(folder):
    """Write all input files; returns the paths the plan needs."""
    folder.mkdir(parents=True, exist_ok=True)
    ego, objs = folder / "ego logs", folder / "objects"
    ego.mkdir()
    objs.mkdir()
    trips = [("C01", "Avatar", "A"), ("C02", "Avatar", "B"), ("C03", "Remote", "C")]
    for n, (pid, _, _) in enumerate(trips):
        data = _ego(1 if n == 0 else 0)
        body = {"Logs": data} if n == 0 else data
        (ego / f"{pid}+1.json").write_text(json.dumps(body) if n < 2 else "{broken", encoding="utf-8")
        (objs / f"{pid}.json").write_text(json.dumps({"Logs": _objects()}), encoding="utf-8")

    def table(name, header, rows, bom=False):
        with open(folder / name, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
            w = csv.writer(f)
            w.writerow(header)
            w.writerows(rows)
        return str(folder / name)

    manifest = table(
        "manifest.csv",
        ["Id", "Condition", "Map", "Scenario", "triggered_by", "KinematicFile", "GPSFile"],
        [[p, c, m, "Accompanied", "Egocar", f"{p}+1.json", f"{p}.json"] for p, c, m in trips]
        + [["C04", "Avatar", "A", "Accompanied", "Egocar", " ", "x.json"], ["D01", "Avatar", "A", "Accompanied", "Egocar", "a", "b"],
           ["C05", "Training", "A", "Accompanied", "Egocar", "a", "b"], ["C06", "Avatar", "A", "Alone", "Egocar", "a", "b"]],
        bom=True,
    )
    kin = table(
        "kinematic.csv",
        ["Id", "Condition", "Map", "triggered_by", "Event_Name", "Onset.SimulationTime", "End.SimulationTime"],
        [["C01", "Avatar", "A", "Egocar", "Braking", 1.01, 1.51], ["C01", "Avatar", "A", "Other", "TurnLeft", 0, 9],
         ["C01", "Avatar", "A", "Egocar", "Accelerating", 1.2, 2.0], ["C02", "Avatar", "B", "Egocar", "Swerve", 0, 9]],
    )
    rows = []
    for pid, cond, m in trips:
        for name, t, kind, why in _EVENTS:
            if pid == "C02" and name == "Start traffic light 1":
                continue
            rows.append([pid, cond, m, "Accompanied", "Egocar", kind, name, t, "", "", "", why])
    for pid in ("C07", "C08", "C09"):  # trips of other participants, for the usual delay
        rows.append([pid, "Avatar", "B", "Accompanied", "Egocar", "Spacial", "StartPoint", 1.0, "", "", "", ""])
        rows.append([pid, "Avatar", "B", "Accompanied", "Egocar", "Spacial", "Start traffic light 1", {"C07": 3, "C08": 4, "C09": 4}[pid], "", "", "", ""])
    for t0, t1, text, who in ((3.0, 3.2, "slow, please", "accompanier"), (3.1, 3.3, "ok", "driver"), (3.1, 3.2, "good", "accompanier"),
                              (12.5, 12.3, "look", ""), (90.0, 91.0, "the end", "driver")):
        rows.append(["C01", "Avatar", "A", "Accompanied", "Egocar", "Transcript", "TranscriptManual", t0, t1, text, who, ""])
    rows.append(["C01", "Avatar", "A", "Accompanied", "Egocar", "Transcript", "TranscriptWhisper", 1.0, 2.0, "noise", "driver", ""])
    rows.append(["C02", "Avatar", "B", "Accompanied", "Egocar", "Transcript", "TranscriptWhisper", 1.0, "", "whisper", "driver", ""])
    events = table(
        "events.csv",
        ["Id", "Condition", "Map", "Scenario", "triggered_by", "Type", "Event_Name", "SimulationTime", "SimulationTimeEnd", "text", "speaker", "Reason"],
        rows,
    )
    points = table(
        "points.csv",
        ["Map", "SpacialEvent", "SimulationPosition.x", "SimulationPosition.y", "traffic_light_id", "ped_start_lat", "ped_start_lon", "ped_end_lat", "ped_end_lon"],
        [row for m in ("A", "B") for row in (
            [m, "Start traffic light 1", "", "", 60, "", "", "", ""],
            [m, "Start section walker2", 125.0, -6.0, "", 31.0 - 3e-5, 34.00125, 31.0 + 3e-5, 34.00125],
            [m, "Egocar Start gap acceptance", 499.8, 3.2, "", "", "", "", ""],
            [m, "Egocar Start gap acceptance", 460.0, 3.0, "", "", "", "", ""],
            [m, "Start overtake car", 600.0, 0.0, "", "", "", "", ""],
        )],
    )
    return {
        "manifest_csv": manifest, "ego_root": str(ego), "object_root": str(objs), "kinematic_csv": kin,
        "events_csv": events, "points_csv": points, "transcripts_csv": events,
    }
