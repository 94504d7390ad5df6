"""The corpus pipeline against its stages run by hand on a small table."""

import hashlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] > 0
    expected = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == expected
