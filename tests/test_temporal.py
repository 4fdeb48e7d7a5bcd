"""Ordered scans and temporal joins against plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from roadlens.operators import joins as J
from roadlens.operators import scan as S


def _rows(seed, n=60, keys=3):
    """Random rows; key 0 holds half of them and several share one time."""
    r = random.Random(seed)
    return [
        (
            0 if r.random() < 0.5 else r.randrange(1, keys),
            float(r.randrange(0, 12)),
            i,
            r.choice([None, 1.0, -2.0, 3.5]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,bits", [(1, 1), (2, 2), (3, 18)])
def test_scans_do_not_depend_on_chunk_size(spark, seed, bits):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "k long, t double, o long, v double").repartition(5)
    seq = S.sequence(df, ["k"], ["t", "o"], chunk_bits=bits)
    got = {
        r["o"]: r
        for r in S.scan(
            seq,
            ["k"],
            lag=S.lag("v"),
            lead=S.lead("v"),
            ffill=S.last_known("v"),
            before=S.last_known("v", inclusive=False),
            bfill=S.next_known("v"),
            total=S.running_sum("v"),
            count=S.running_count("v"),
            top=S.running_max("v"),
            whole=S.total_sum("v"),
            first=S.first_of_all("v"),
        ).collect()
    }
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        vals = [r[3] for r in part]
        for i, r in enumerate(part):
            upto = [v for v in vals[: i + 1] if v is not None]
            prev = [v for v in vals[:i] if v is not None]
            rest = [v for v in vals[i:] if v is not None]
            known = [v for v in vals if v is not None]
            g = got[r[2]]
            assert g["lag"] == (vals[i - 1] if i else None)
            assert g["lead"] == (vals[i + 1] if i + 1 < len(vals) else None)
            assert g["ffill"] == (upto[-1] if upto else None)
            assert g["before"] == (prev[-1] if prev else None)
            assert g["bfill"] == (rest[0] if rest else None)
            assert g["total"] == (pytest.approx(sum(upto)) if upto else None)
            assert g["count"] == len(upto)
            assert g["top"] == (max(upto) if upto else None)
            assert g["whole"] == pytest.approx(sum(known))
            assert g["first"] == known[0]


@pytest.mark.parametrize("block", [3, 5, 1 << 18])
def test_neighbours_cross_block_borders(spark, block):
    rows = _rows(7, n=40, keys=2)
    df = spark.createDataFrame(rows, "k long, t double, o long, v double")
    seq = S.sequence(df, ["k"], ["t", "o"], chunk_bits=1)
    out = S.neighbours(
        seq,
        ["k"],
        2,
        3,
        lambda w: {
            "n": F.count("v").over(w.rowsBetween(-2, 0)),
            "ahead": F.lead("o", 3).over(w),
        },
        block_rows=block,
    )
    got = {r["o"]: (r["n"], r["ahead"]) for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(part):
            n = sum(x[3] is not None for x in part[max(0, i - 2) : i + 1])
            ahead = part[i + 3][2] if i + 3 < len(part) else None
            assert got[r[2]] == (n, ahead)


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("bits", [1, 18])
def test_asof(spark, direction, bits):
    r = random.Random(11)
    left = [(r.randrange(3), float(r.randrange(0, 30)), i) for i in range(40)]
    left.append((0, None, 99))
    right = [(r.randrange(2), float(r.randrange(5, 25)), i, f"v{i}") for i in range(25)]
    got = {
        x["id"]: (x["p_name"], x["p_at"])
        for x in J.asof_join(
            spark.createDataFrame(left, "k long, t double, id long"),
            spark.createDataFrame(right, "k long, t double, o long, name string"),
            ["k"],
            "t",
            ["name"],
            right_order="o",
            direction=direction,
            prefix="p_",
            chunk_bits=bits,
        ).collect()
    }
    assert len(got) == len(left)
    for k, t, i in left:
        cand = [x for x in right if x[0] == k and t is not None]
        if direction == "backward":
            cand = [x for x in cand if x[1] <= t]
        if direction == "forward":
            cand = [x for x in cand if x[1] >= t]
        best = min(cand, key=lambda x: (abs(x[1] - t), x[1], x[2])) if cand else None
        assert got[i] == ((best[3], best[1]) if best else (None, None))


def test_asof_tolerance(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 5.0)], "k long, t double")
    right = spark.createDataFrame([(1, 2.0, "a")], "k long, t double, n string")
    got = {r["t"]: r["n"] for r in J.asof_join(left, right, ["k"], "t", ["n"], tolerance=1.0).collect()}
    assert got == {1.0: "a", 5.0: None}


@pytest.mark.parametrize("bits", [1, 18])
def test_nearest_row_ties_and_chunks(spark, bits):
    r = random.Random(5)
    frames = [(r.randrange(2), float(r.randrange(0, 40)), i) for i in range(50)]
    targets = [(r.randrange(3), r.randrange(-5, 50) / 1.0 + r.choice([0, 0.5]), i) for i in range(20)]
    seq = S.sequence(spark.createDataFrame(frames, "k long, t double, o long"), ["k"], ["t", "o"], bits)
    tg = spark.createDataFrame(targets, "k long, x double, id long")
    order = {row[S.SEQ]: row["o"] for row in seq.collect()}
    got = {row["id"]: order[row[S.SEQ]] for row in J.nearest_row(seq, tg, ["k"], "t", "x").collect()}
    want = {}
    for k, x, i in targets:
        cand = [f for f in frames if f[0] == k]
        if cand:
            want[i] = min(cand, key=lambda f: (abs(f[1] - x), f[1], f[2]))[2]
    assert got == want


def _inside(spark, pts, ivs, closed="both"):
    points = spark.createDataFrame(pts, "k long, t double, p long")
    intervals = spark.createDataFrame(ivs, "k long, a double, b double, i long")
    return sorted((x["p"], x["i"]) for x in J.interval_join(points, intervals, ["k"], "t", "a", "b", closed=closed).collect())


def _inside_by_hand(pts, ivs, closed="both"):
    lo = (lambda t, a: t >= a) if closed in ("both", "left") else (lambda t, a: t > a)
    hi = (lambda t, b: t <= b) if closed in ("both", "right") else (lambda t, b: t < b)
    known = [v for v in ivs if None not in v[:3]]
    return sorted((p[2], v[3]) for p in pts for v in known if None not in p[:2] and p[0] == v[0] and v[1] <= v[2] and lo(p[1], v[1]) and hi(p[1], v[2]))


@pytest.mark.parametrize("closed", ["both", "neither", "left", "right"])
@pytest.mark.parametrize("unit", [1.0, 1e-5, 3e7])
def test_interval_join(spark, closed, unit):
    r = random.Random(3)
    pts = [(r.randrange(3), r.randrange(-30, 30) * unit, i) for i in range(60)] + [(1, None, 98), (None, 1.0, 99)]
    ivs = []
    for i in range(30):
        a = r.randrange(-32, 28) * unit
        ivs.append((r.randrange(2), a, a + r.choice([0, 1, 2, 20, -3, 1e6]) * unit, i))
    inf = float("inf")
    ivs += [(1, -inf, inf, 50), (0, 2 * unit, inf, 51), (1, None, 3.0, 52), (1, 3.0, None, 53), (None, 0.0, 9.0, 54), (0, -1e300, 1e300, 55), (0, -inf, -inf, 56)]
    assert _inside(spark, pts, ivs, closed) == _inside_by_hand(pts, ivs, closed)
    assert _inside(spark, pts, [], closed) == []


def test_long_interval_takes_as_few_cells_as_any(spark):
    ivs = [(0, float(i), i + 1.5, i) for i in range(200)] + [(0, 0.25, 1.5e6 + 0.25, 900), (0, -3.0, 1e12, 901)]
    index = J.interval_index(spark.createDataFrame(ivs, "k long, a double, b double, i long"), "a", "b")
    cells = {r["i"]: len(r["_cell"]) for r in index.collect()}
    assert max(cells.values()) == 2 and len(cells) == 202
    levels = {r["i"]: r["_level"] for r in index.collect()}
    assert len({levels[i] for i in range(200)}) == 1 and levels[901] > levels[900] > levels[0]


def test_intervals_are_read_once(spark):
    """The written index is all that later steps read of the intervals."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ivs = spark.range(100).selectExpr("0 as k", "cast(id as double) as a", "cast(id + id % 7 as double) as b", "id as i")
    counted = ivs.mapInArrow(count, ivs.schema)
    pts = spark.range(50).selectExpr("0 as k", "cast(id as double) as t", "id as p")
    assert J.interval_join(pts, counted, ["k"], "t", "a", "b").count() > 50
    assert seen.value == 100


def test_box_match_edges(spark):
    pts = [("A", 0.0, 0.0, "p"), ("A", 10.0, -3.2, "q")]
    objs = [("A", 0.5, -0.5, "on edge"), ("A", 0.51, 0.0, "out"), ("A", 9.6, -3.0, "in"), ("B", 0.0, 0.0, "other")]
    out = J.box_match(
        spark.createDataFrame(pts, "m string, x double, y double, p string"),
        spark.createDataFrame(objs, "m string, ox double, oy double, o string"),
        ["m"],
        ("x", "y"),
        ("ox", "oy"),
        0.5,
    )
    assert {(r["p"], r["o"]) for r in out.collect()} == {("p", "on edge"), ("q", "in")}
