import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name
        assert len(kept) > 0.5 * len(ids), name
        if name != "mixing":
            assert out.columns == docs.columns, name
            docs, ids = out, set(kept)


def test_run_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name
        out = stage(spark, odd_docs, sf_dir)
        out.collect()
        if name != "mixing":
            assert out.columns == odd_docs.columns, name
