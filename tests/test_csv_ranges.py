import csv
import io
import random

import pytest

from roadlens.operators import quality as Q
from roadlens.sources import csv_ranges as R


def _records(n, seed):
    r = random.Random(seed)
    parts = ["a", ",", "\n", '"', "\r\n", "é", " ", "שלום", '""', "x" * 30]
    return [["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 5))] for _ in range(n)]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_line_breaks_inside_quotes_keep_the_record(spark, tmp_path, size):
    want = {}
    for i in range(3):
        records = _records(40, i)
        text = io.StringIO()
        csv.writer(text, lineterminator="\r\n" if i == 1 else "\n", quoting=csv.QUOTE_ALL if i == 2 else csv.QUOTE_MINIMAL).writerows(records)
        body = text.getvalue()
        (tmp_path / f"{i}.csv").write_bytes(("\ufeff" if i == 0 else "").encode() + (body[:-1] if i == 2 else body).encode())
        want[f"{i}.csv"] = [(k, row) for k, row in enumerate(csv.reader(io.StringIO(body, newline="")))]
    files = spark.createDataFrame([(f"{i}.csv",) for i in range(3)] + [("missing.csv",), (None,)], "file string")
    got = {}
    for r in Q.read_ragged(files, str(tmp_path), size=size).orderBy("file", "ord").collect():
        assert r["n_fields"] == len(r["fields"])
        got.setdefault(r["file"], []).append((r["ord"], [f for f in r["fields"]]))
    # an empty record has one empty field here
    assert got == {f: [(k, row or [""]) for k, row in rows] for f, rows in want.items()}


def test_open_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"rest,\nof\nfile')
    (tmp_path / "empty.csv").write_text("")
    files = spark.createDataFrame([("open.csv",), ("empty.csv",)], "file string")
    rows = [(r["file"], r["ord"], r["fields"]) for r in Q.read_ragged(files, str(tmp_path), size=5).orderBy("ord").collect()]
    assert rows == [("open.csv", 0, ["a", "b"]), ("open.csv", 1, ["1", "rest,\nof\nfile"])]


def test_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f'{i},"line\nbreak, {i}",x\n' for i in range(30000)))
    files = spark.createDataFrame([("big.csv",)], "file string")
    rows = R.read_lines(files, str(tmp_path), size=1 << 16)
    assert rows.count() == 30000 and rows.where("value not like concat(ord, ',%')").count() == 0
    assert R.file_ranges(files, str(tmp_path), 1 << 16).count() == 13


def test_long_quoted_field(spark):
    text = '"' + 'ab""c,\n' * 40000 + '",tail'
    row = Q.split_ragged(spark.createDataFrame([(text,), (None,)], "value string")).collect()
    assert row[0]["n_fields"] == 2 and row[0]["fields"][1] == "tail" and len(row[0]["fields"][0]) == 40000 * 6
    assert row[1]["fields"] is None
