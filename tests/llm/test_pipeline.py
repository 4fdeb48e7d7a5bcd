import corpus_pipeline as p
from odd import documents, empty
from roadlens.llm import jaccard_join, mixing


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf_dir, columns = "/root/testdata/sf0.001", docs.columns
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert all(a >= b > 0 for a, b in zip(sizes, sizes[1:]))
    final = p.STAGES[-1][1](spark, docs, sf_dir)
    want = sorted((r.doc_id, list(r.ids)) for r in final.collect())
    assert sorted((r.doc_id, list(r.ids)) for r in p.run(spark, sf_dir).collect()) == want
    # nothing that is left is a near copy of anything else, and every document was drawn
    before = spark.read.parquet(f"{tmp_path}/near_copies")
    linked = jaccard_join.join(before).where("component_id <> doc_id").count()
    assert linked == 0
    drawn = {r.doc_id for r in mixing.mix(before).where("mix.keep").collect()}
    assert drawn == {i for i, _ in want}


def test_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (9, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents(spark), empty(spark)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "lang", "source", "ids"] and docs.count() >= 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_copies", "mixing", "encode"]
