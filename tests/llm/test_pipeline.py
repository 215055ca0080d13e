"""The pipeline's stages on planted rows."""

from tesselq.llm.common import materialize


def test_stages(spark, tmp_path):
    import corpus_pipeline

    from .conftest import SCHEMA, prose

    good = prose(120, 20)
    leak = prose(1, 21)[0]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(500 + i, "BAD!! " * 40, "en", "s", 240) for i in range(20)]
    rows += [(300, good[0], "en", "s", len(good[0])), (301, f"{good[1]} {leak} {good[2]}", "en", "s", 9), (302, f"{good[3]} extra words password=abcdef1234567890 {good[4]}", "en", "s", 9), (None, "no id", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(500 + i, 0, 0) for i in range(8)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        seen.append({r["doc_id"] for r in out.collect()})
        docs = out
    assert set(range(120)) | {300, 301, 302} <= seen[0] and not seen[0] & set(range(500, 520))
    assert seen[0] - seen[1] == {300}
    assert seen[1] - seen[2] == {301}
    assert seen[2] == seen[3] and "abcdef1234567890" not in docs.where("doc_id = 302").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == seen[3]
