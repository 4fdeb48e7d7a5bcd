import json
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from roadlens.sources import json_ranges as R

RECORD = T.StructType(
    [
        T.StructField("Type", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("Pos", T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])),
    ]
)
TEXTS = ["plain", 'a "quoted" word', "},{", '{"Logs":[{"n":1}]}', "back\\slash", "\\" * 5 + '"', "]}", "שלום }{ é", '\\"},{\\"', "", '"']


def _records(n, seed):
    r = random.Random(seed)
    return [{"Type": r.choice(TEXTS) * r.randint(1, 3), "n": i, "Pos": {"x": str(i), "y": r.choice(TEXTS)}, "more": [[1, {"a": "]"}]]} for i in range(n)]


def _write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return name


def _read(spark, folder, names, size):
    files = spark.createDataFrame([(n,) for n in names], "file string")
    out = {}
    for r in R.read_log_records(files, str(folder), RECORD, size=size).orderBy("file", "ord").collect():
        out.setdefault(r["file"], []).append((r["ord"], r["Type"], r["n"], r["Pos"] and (r["Pos"]["x"], r["Pos"]["y"])))
    return out


def _want(records):
    return [(i, x["Type"], x["n"], (x["Pos"]["x"], x["Pos"]["y"])) for i, x in enumerate(records)]


@pytest.mark.parametrize("size", [11, 97, 1000, 1 << 20])
def test_ranges_give_the_records_of_the_file(spark, tmp_path, size):
    logs = {f"{i}.json": _records(25, i) for i in range(3)}
    names = [
        _write(tmp_path, "0.json", json.dumps({"Logs": logs["0.json"]}, ensure_ascii=False)),
        _write(tmp_path, "1.json", json.dumps(logs["1.json"], indent=2)),
        _write(tmp_path, "2.json", "﻿ \n" + json.dumps({"About": {"Logs": [{"n": 7}]}, "name": "Logs", "Logs": logs["2.json"], "Other": [{"n": 8}]})),
    ]
    assert _read(spark, tmp_path, names, size) == {n: _want(logs[n]) for n in names}


def test_files_without_records(spark, tmp_path):
    good = json.dumps(_records(3, 1))
    names = [
        _write(tmp_path, "cut.json", good[:-9]),
        _write(tmp_path, "in string.json", '[{"Type": "x}, {"n": 1}]'),
        _write(tmp_path, "empty.json", ""),
        _write(tmp_path, "blank.json", "  \n"),
        _write(tmp_path, "none.json", '{"Logs": []}'),
        _write(tmp_path, "other.json", '{"Records": [{"n": 1}]}'),
        _write(tmp_path, "number.json", "17"),
        _write(tmp_path, "bad record.json", '[{"n": 1}, {"n": oops}]'),
        _write(tmp_path, "good+%20.json", good),
    ]
    for size in (20, 1 << 20):
        assert set(_read(spark, tmp_path, [*names, "missing.json", None], size)) == {"good+%20.json"}


def test_large_file_is_read_by_many_tasks(spark, tmp_path):
    body = ",".join(json.dumps({"Type": "GPS },{" if i % 3 else "x", "n": i, "Pos": {"x": "1", "y": "2"}}) for i in range(40000))
    (tmp_path / "big.json").write_text('{"Logs": [' + body + "]}")
    files = spark.createDataFrame([("big.json",)], "file string")
    rows = R.read_log_records(files, str(tmp_path), RECORD, size=1 << 17)
    assert rows.where("ord <> n").count() == 0 and rows.count() == 40000
    ranges = R.file_ranges(files, str(tmp_path), 1 << 17)
    assert ranges.count() == 18 and R.spread(ranges, 18).rdd.getNumPartitions() == 18


def test_structure_knows_strings():
    r = random.Random(5)
    for _ in range(200):
        text = json.dumps([{"k" + r.choice(TEXTS): r.choice(TEXTS), "v": [r.choice(TEXTS)]} for _ in range(r.randint(0, 4))]).encode()
        cut = r.randint(0, len(text))
        quoted, depth, escaped = False, 0, False
        for b in text[:cut]:
            if escaped:
                escaped = False
            elif quoted and b == 92:
                escaped = True
            elif b == 34:
                quoted = not quoted
            elif not quoted and b in b"{[":
                depth += 1
            elif not quoted and b in b"}]":
                depth -= 1
        head = R.Structure(np.frombuffer(text[:cut], np.uint8), False, 0)
        assert (head.ends_quoted(), head.ends_at()) == (quoted, depth)
        lead = cut - len(text[:cut].rstrip(b"\\"))
        tail = R.Structure(np.frombuffer(text[cut:], np.uint8), quoted, depth, lead)
        assert (tail.ends_quoted(), tail.ends_at()) == (False, 0)


def test_small_ranges_share_tasks():
    from roadlens.sources import ranges as R

    assert R.tasks(0, 0) == 1 and R.tasks(5, 5 << 16) == 5
    # 10 GB in ranges of 64 KB: tasks follow the bytes, not the ranges
    assert R.tasks(163_840, 10 << 30) == 1280 and R.tasks(16_384, 1 << 30) == 128
    assert R.tasks(1280, 10 << 30) == 1280
