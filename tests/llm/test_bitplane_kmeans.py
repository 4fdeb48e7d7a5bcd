import hashlib

import numpy as np
import pytest
from roadlens.llm import bitplane_kmeans as b

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, planes int"


def brute(rows, k, rounds):
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    points = [[int(np.floor(256 * x)) for x in v] for _, v in good]
    key = lambda i: (good[i][0] is None, hashlib.sha256(f"2:{good[i][0]}".encode()).hexdigest(), good[i][1])
    centres = [points[i] for i in sorted(range(len(good)), key=key)[:k]]

    def assign():
        out = []
        for p in points:
            ds = [sum((x - y) ** 2 for x, y in zip(p, c)) for c in centres]
            out.append((min(ds), ds.index(min(ds))))
        return out

    for _ in range(rounds):
        dealt = assign()
        for c in range(len(centres)):
            mine = [p for p, (_, x) in zip(points, dealt) if x == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(good, assign())), key=repr), centres


def got(spark, rows, k, rounds):
    df = spark.createDataFrame([(i, v, "x", "y", 0) for i, v in rows], SCHEMA).repartition(3)
    out, centres = b.cluster(df, clusters=k, rounds=rounds)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=repr), centres, out


def test_planes_give_dot_products():
    rng = np.random.default_rng(0)
    for top in (1, 5, 1000, 1 << 27, 1 << 40, 1 << 100):
        a = np.array([[int(x) for x in row] for row in rng.uniform(-1, 1, (7, 64)) * float(top)], object)
        c = np.array([[int(x) for x in row] for row in rng.uniform(-1, 1, (3, 64)) * float(top)], object)
        if top < 1 << 60:
            a, c = a.astype(np.int64), c.astype(np.int64)
        assert (b.unpack(b.pack(a)).astype(object) == a.astype(object)).all()
        assert (b.dots(b.pack(a), b.pack(c)).astype(object) == a.astype(object) @ c.astype(object).T).all()
        label, distance = b.nearest(b.pack(a), b.pack(c))
        want = [[sum((x - y) ** 2 for x, y in zip(r, s)) for s in c.tolist()] for r in a.tolist()]
        assert distance.tolist() == [min(w) for w in want] and label.tolist() == [w.index(min(w)) for w in want]


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(size=64) * 0.3).tolist()) for i in range(150)]
    rows += [(200 + i % 3, [0.25] * 64) for i in range(40)]  # copies and repeated ids
    rows += [(None, [0.1] * 64), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [])]
    found, centres, out = got(spark, rows, 8, 3)
    want, want_centres = brute(rows, 8, 3)
    assert found == want and centres == want_centres
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    for r in out.collect():
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centres[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("scale", [1e5, 1e30])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=64) * (scale if i % 5 == 0 else 1)).tolist()) for i in range(40)]
    found, centres, out = got(spark, rows, 4, 2)
    want, want_centres = brute(rows, 4, 2)
    assert centres == want_centres
    assert found == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=repr)


def test_few_and_no_rows(spark):
    assert got(spark, [], 40, 5)[0] == []
    rows = [(5, [0.5] * 64), (6, [-0.5] * 64)]
    assert got(spark, rows, 40, 5)[0] == brute(rows, 40, 5)[0]
