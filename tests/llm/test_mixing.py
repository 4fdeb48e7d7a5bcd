import pytest
from odd import ROWS, documents, empty
from pyspark.sql import functions as F
from roadlens.llm import mixing as m


def test_margins_meet_their_targets(spark):
    cells = [(s, l, t, 10 + 7 * i + 13 * j + 90 * k * (i == 0)) for i, s in enumerate("abc") for j, l in enumerate("xy") for k, t in enumerate("pqr") if (s, l, t) != ("c", "y", "r")]
    temper = {"source": 0.5, "lang": 0.0, "topic": 1.0}
    out = m.rake(spark.createDataFrame([*cells, ("a", "x", "none", 0)], "source string, lang string, topic string, tokens long"), temper).collect()
    assert len(out) == len(cells) and max(r.p for r in out) == pytest.approx(1) and min(r.p for r in out) > 0
    total = sum(c[3] for c in cells)
    for at, (d, power) in enumerate(temper.items()):
        share = {}
        for c in cells:
            share[c[at]] = share.get(c[at], 0) + c[3] / total
        whole = sum(s**power for s in share.values())
        for value, s in share.items():
            assert sum(r.weight for r in out if r[d] == value) == pytest.approx(s**power / whole, rel=1e-8)
            # expected tokens of the drawn documents have the same shares
            drawn = sum(r.tokens * r.p for r in out)
            assert sum(r.tokens * r.p for r in out if r[d] == value) / drawn == pytest.approx(s**power / whole, rel=1e-8)


def test_contradicting_targets_end(spark):
    cells = spark.createDataFrame([("a", "x", 90), ("b", "y", 10)], "source string, lang string, tokens long")
    out = {r.source: r.p for r in m.rake(cells, {"source": 0.0, "lang": 1.0}).collect()}
    assert out == {"a": 1.0, "b": pytest.approx(1.0)}


def test_odd_rows(spark):
    docs = documents(spark)
    out = m.mix(docs).collect()
    assert len(out) == len(ROWS) and out[0].__fields__ == [*docs.columns, "mix"]
    for r in out:
        assert r.mix.n_tokens == (r.text.count(" ") + r.text.count("\n") + 1 if r.text else 0)
        assert 0 <= r.mix.p <= 1 and (r.text or not r.mix.keep)
    same = [r.mix for r in out if r.doc_id == 2]
    assert same[0] == same[1]
    assert m.mix(empty(spark)).collect() == []
    assert m.stage(spark, docs, "").columns == docs.columns


def test_draws_follow_the_probabilities(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.lit("en").alias("lang"))
    out = m.mix(docs).groupBy("source").agg(F.avg("mix.p").alias("p"), F.avg(F.col("mix.keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    for r in out:
        assert abs(r.p - r.kept) < 4 * (0.25 / r.n) ** 0.5 + 1e-9


def test_twin(spark):
    from tests.oracle import compare, connect

    sf_dir = "/root/testdata/sf0.01"
    assert compare(m.op10(spark, sf_dir), connect(sf_dir), m._sql()) == ""


def test_slow_targets_are_met(spark):
    # two sources tied to a language each: for some thirty sweeps next to nothing moves
    cells = [("a", "x", 600_000_000), ("b", "y", 400_000_000), ("a", "y", 50), ("b", "x", 50)]
    out = m.rake(spark.createDataFrame(cells, "source string, lang string, tokens long"), {"source": 0.0, "lang": 1.0}).collect()
    for s in "ab":
        assert sum(r.weight for r in out if r.source == s) == pytest.approx(0.5, rel=1e-8)
    for l, share in (("x", 600_000_050 / 1_000_000_100), ("y", 400_000_050 / 1_000_000_100)):
        assert sum(r.weight for r in out if r.lang == l) == pytest.approx(share, rel=1e-8)
    assert max(max(r.gap_source, r.gap_lang) for r in out) < 1e-8


def test_gaps_of_contradicting_targets_are_told(spark):
    # nothing can carry b in x, and a in y fades away
    cells = [("a", "x", 600), ("b", "y", 350), ("a", "y", 50)]
    out = {(r.source, r.lang): r for r in m.rake(spark.createDataFrame(cells, "source string, lang string, tokens long"), {"source": 0.0, "lang": 1.0}).collect()}
    assert out["a", "x"].weight == pytest.approx(0.6) and out["b", "y"].weight == pytest.approx(0.4) and out["a", "y"].weight < 1e-8
    assert out["a", "x"].gap_source == pytest.approx(0.2) and out["b", "y"].gap_source == pytest.approx(0.2)
    assert all(r.gap_lang < 1e-9 for r in out.values())


def test_a_scarce_cell_does_not_set_the_size(spark):
    cells = [(s, l, 1000 * (3 + i) * (1 + 2 * j)) for i, s in enumerate("abcd") for j, l in enumerate("xy")]
    for scarce in ([], [("rare", "x", 60)], [("rare", "x", 60), ("rarer", "z", 1)]):
        for scale in (1, 300):
            rows = [(s, l, n * scale) for s, l, n in cells] + scarce
            out = m.budgeted(spark.createDataFrame(rows, "source string, lang string, tokens long"), {"source": 0.5, "lang": 0.7}, 0.5).collect()
            assert len(out) == len(rows) and all(0 < r.p <= 1 for r in out)
            assert sum(r.p * r.tokens for r in out) == pytest.approx(0.5 * sum(r[2] for r in rows), rel=1e-6)
            assert all(r.p == 1 for r in out if r.source.startswith("rare"))
            if not scarce:  # nothing is short: the targets are met
                want = {s: sum(r[2] for r in rows if r[0] == s) ** 0.5 for s in "abcd"}
                for s, w in want.items():
                    drawn = sum(r.p * r.tokens for r in out if r.source == s) / sum(r.p * r.tokens for r in out)
                    assert drawn == pytest.approx(w / sum(want.values()), rel=1e-6)
