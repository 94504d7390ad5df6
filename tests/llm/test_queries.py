"""The registered queries on a table with nulls, ties, repeated rows and columns of the operators' own names."""

import hashlib
import zlib

import pytest

from tessera.llm import bpe, language, media, mixing, quality, registry, simhash, toxicity

TEXTS = [None, "", " \n", "a b c d e f", "a b c d e f", "alpha beta gamma " * 40, "x" * 300, "Das ist ein Satz und noch einer. " * 12, "the river walks over the hills. " * 12]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(None if i == 3 else i, t, ["en", "de", None][i % 3], ["s1", None][i % 2], i, "x", "y", [1.5], "z", "k", "c") for i, t in enumerate([*TEXTS, *TEXTS])]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _words string, _row string, row array<double>, key string, component string, size string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(18)] + [(5, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def held_out(i, divisor):
    return zlib.crc32(("" if i is None else str(i)).encode()) % divisor


def test_columns_and_rows(spark, folder):
    d, rows = folder
    op1 = language.op1_language_mixture(spark, d).collect()
    assert len(op1) == len(rows) and all(r.held_out == (held_out(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in op1)
    assert {r.lang_pred for r in op1 if r.doc_id in (0, 1, 2)} == {"und"}
    op2 = simhash.op2_simhash_pivots(spark, d).collect()
    assert len(op2) == len(rows) and all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in op2)
    assert {r.component_id for r in op2 if r.doc_id in (0, 1, 2, 9, 10, 11)} == {0}
    op3 = quality.op3_quality_divergence(spark, d).collect()
    assert len(op3) == len(rows) and all(r.base_failed for r in op3 if r.n_words < 20) and not any(r.kept and r.base_failed for r in op3)
    op4 = {r.doc_id: r for r in bpe.op4_byte_bpe(spark, d).collect()}
    assert op4[6].decoded_sha256 == hashlib.sha256(TEXTS[6].encode()).hexdigest() and op4[0].n_tokens == 0
    op6 = {r.doc_id: r for r in media.op6_png_media(spark, d).collect()}
    assert op6[0].payload_bytes == 64 and op6[6].n_bytes == 300 and op6[6].payload_bytes == 320
    assert op6[6][2:] == op6[15][2:]
    op7 = toxicity.op7_toxicity_nbsvm(spark, d).collect()
    assert len(op7) == len(rows) and all(r.held_out == (held_out(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) for r in op7)
    op10 = mixing.op10_source_mixing(spark, d).collect()
    assert len(op10) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in op10)


def test_empty_tables(spark, folder, tmp_path):
    d, _ = folder
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, run in registry.queries().items():
        if name not in ("op5_dom_content", "pipeline"):
            assert run(spark, str(tmp_path)).count() == 0, name


def test_stages_keep_columns(spark, folder):
    import corpus_pipeline

    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0
