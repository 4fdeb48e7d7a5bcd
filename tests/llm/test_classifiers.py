import numpy as np
import pytest
from odd import ROWS, documents, empty
from pyspark.sql import functions as F
from roadlens.llm import language_cnn as c
from roadlens.llm import quality_cotraining as q

SHIPPED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    return c.train(spark.read.parquet(f"{SHIPPED}/documents.parquet"))


def test_language_of_held_out_documents(spark, network):
    docs = spark.read.parquet(f"{SHIPPED}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "text")
    out = c.identify(docs, network, id_col="id").join(docs, F.col("doc_id") == F.col("id")).where("held_out").collect()
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.95
    folds = {r.doc_id: r.f for r in docs.select(F.col("id").alias("doc_id"), c.fold(F.col("id")).alias("f")).collect()}
    assert all(folds[r.doc_id] == 2 for r in out)


def test_language_of_odd_rows(spark, network):
    out = c.identify(documents(spark), network).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert 0 <= r.score <= 1 and (r.lang_pred in network[0] or r.lang_pred == "und")
    by_id = {r.doc_id: r for r in out}
    assert by_id[4].lang_pred == by_id[5].lang_pred == by_id[6].lang_pred == "und"
    assert by_id[1].lang_pred == "en" and by_id[None].held_out is False
    assert c.identify(empty(spark), network).collect() == []
    assert {r.lang_pred for r in c.identify(documents(spark), None).collect()} == {"und"}
    assert c.train(empty(spark)) is None


def test_language_ignores_labels_and_held_out_rows(spark, network):
    docs = spark.read.parquet(f"{SHIPPED}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(c.fold(F.col("doc_id")) == 2, "xx").otherwise(F.col("lang")))
    langs, again = c.train(spoilt)
    assert langs == network[0] and np.array_equal(again.filters, network[1].filters)


def test_windows_cover_the_whole_text():
    text = "äbc" * 500
    rows, held = c.windows(text)
    raw = text.encode()
    assert held.sum() == len(raw) and b"".join(r[: c.WINDOW].tobytes() for r in rows)[: len(raw)] == raw


def test_quality_of_documents_it_did_not_see(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    model = q.fit(docs, labels.where(seen))
    out = q.score(docs, model).join(labels.where(~seen).withColumnRenamed("quality", "y"), "doc_id").select("y", "quality.*").collect()
    good, bad = [r for r in out if r.y == 1], [r for r in out if r.y == 0]
    assert np.mean([r.keep for r in good]) >= 0.99 and np.mean([not r.keep for r in bad]) >= 0.85


def test_cotraining_teaches_the_other_view():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000).astype(float)
    text, meta = (np.c_[2.5 * (2 * y - 1) + rng.normal(size=3000), rng.normal(size=(3000, 3))] for _ in range(2))
    known, held = np.arange(3000) < 60, np.arange(3000) % 3 == 0
    model = q.cotrain(text[known], meta[known], y[known], held[known], text[~known], meta[~known])
    assert min(model.pseudo) > 300
    _, _, p = model.scores(text[~known], meta[~known])
    assert np.mean((p >= 0.5) == (y[~known] == 1)) > 0.98


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (8, 0, 0), (9, 0, 0), (10, 1, 0), (None, 0, 0), (77, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = q.score(docs.drop("score"), q.fit(docs, labels)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert 0 <= r.quality.score <= 1 and r.quality.keep == (r.quality.score >= 0.5)
        assert r.text or r.quality.score == 0
    assert q.fit(docs, labels.limit(0)) is None and q.fit(empty(spark), labels) is None
    assert q.fit(docs, labels.where("quality = 1")) == 1.0
    assert all(r.quality.keep for r in q.score(docs, None).collect() if (r.text or "").strip(" "))
    assert q.score(empty(spark), None).collect() == []
