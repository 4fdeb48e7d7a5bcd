import numpy as np
import pytest
from roadlens.llm import vector_graph as g

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def brute(rows, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    length = max({len(v) for _, v in good}, key=lambda d: sum(len(v) == d for _, v in good))
    good = [(i, v) for i, v in good if len(v) == length]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted((-float((v * w).sum()), j) for j, w in good if j != i)[:k]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], SCHEMA)
    index = g.build_index(df, **options)
    out = {}
    for r in g.search(index, df.where("vec_id % 20 = 0")).collect():
        out.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    return {q: [x[k] for k in sorted(x)] for q, x in out.items()}, {q: sorted(x) for q, x in out.items()}


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(size=4) * (1 + i % 3)).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.5, 0.0]) for i in range(50)]  # copies; 100, 120 and 140 are queries
    rows += [(1000, None), (1020, [0.0] * 4), (1040, [1.0, float("nan"), 0.0, 0.0]), (1060, [1.0, None, 0.0, 0.0]), (1080, [float("inf"), 0.0, 0.0, 0.0]), (1100, [1.0, 2.0]), (None, [1.0] * 4)]
    got, ranks = found(spark, rows)
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert ranks[q] == list(range(1, len(want[q]) + 1))
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("shard_rows", [400, 5000])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    rows = [(i, np.float32(centres[i % 20] + rng.normal(size=32) * 0.7).tolist()) for i in range(2000)]
    got, _ = found(spark, rows, shard_rows=shard_rows)
    want = brute(rows)
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95


def test_empty_and_single(spark):
    assert found(spark, [])[0] == {}
    assert found(spark, [(20, [1.0, 2.0])])[0] == {}
    assert found(spark, [(20, [1.0, 2.0]), (21, [1.0, 1.0])])[0] == {20: [(-3.0, 21)]}


def test_shipped_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = {}
    for r in g.search(g.build_index(df, shard_rows=1000), df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows)
    assert np.mean([len(got[q] & {j for _, j in want[q]}) / len(want[q]) for q in want]) >= 0.9
