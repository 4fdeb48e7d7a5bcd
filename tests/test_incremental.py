"""Incremental runs: files are taken once, trips are written once."""

import csv

from pyspark.sql import functions as F

from roadlens.plans import enrich
from roadlens.streaming import incremental


def _manifest(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(incremental.MANIFEST.names)
        w.writerows(rows)


def test_new_files_only(spark, tmp_path, monkeypatch):
    seen = []

    def inputs(session, *, manifest, **paths):
        seen.append(sorted(r["Id"] for r in manifest.collect()))
        return manifest

    # the enrichment itself has its own tests; here every trip gives one frame, C9 none
    monkeypatch.setattr(enrich, "read_inputs", inputs)
    monkeypatch.setattr(enrich, "enrich", lambda m: m.where("Id <> 'C9'").select("Id", "Condition", "Map", F.lit(1.0).alias("Speed")))
    folder, out, bad = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad")
    folder.mkdir()
    row = lambda i, f="a.json": [i, "Avatar", "A", "Accompanied", "Egocar", f, "b.json"]
    _manifest(folder / "1.csv", [row("C1"), row("C2"), row("C3", ""), row("C9")])
    args = (spark, str(folder), out, bad, str(tmp_path / "checkpoint"))
    incremental.run_available(*args)
    incremental.run_available(*args)  # nothing new
    _manifest(folder / "2.csv", [row("C2"), row("C4")])
    incremental.run_available(*args)
    assert seen == [["C1", "C2", "C9"], ["C4"]]
    assert sorted(r["Id"] for r in spark.read.parquet(out).collect()) == ["C1", "C2", "C4"]
    assert sorted((r["Id"], r["FailedStep"]) for r in spark.read.parquet(bad).collect()) == [("C3", "KinematicFile"), ("C9", "frames")]
