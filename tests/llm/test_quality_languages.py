"""The quality operator on tables with rare languages and unlabelled rows, against its SQL."""

import random

import duckdb
import pytest

from tessera.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and house river walks slowly over green hills while birds sing",
    "de": "das Haus Fluss geht langsam hinter grünen Hügeln während Vögel singen",
    "ar": "البيت النهر يمشي ببطء فوق التلال الخضراء بينما الطيور تغني في الصباح",
    "xx": "zu za zi zo",
}


def prose(r, lang, n):
    return " ".join(r.choices(WORDS[lang].split(), k=n)) + "."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    out = [(i, prose(r, "en", 3000), "en") for i in range(150)]
    out += [(200 + i, " ".join(r.choices(["ABRA", "###", "KADABRA", "XYZ"], k=30)), "en") for i in range(4)]
    out += [(300 + i, prose(r, "ar", 60), "ar") for i in range(45)] + [(400 + i, prose(r, "ar", 60), None) for i in range(3)]
    out += [(500, prose(r, "ar", 60).replace(" ", " ### "), "ar"), (501, prose(r, "de", 45), "de"), (502, prose(r, "xx", 60), "xx"), (503, None, "en"), (504, "", None), (505, None, None), (506, prose(r, "en", 60), "")]
    return out


def test_one_rare_row_changes_no_other(spark, rows):
    def kept(chosen):
        docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in chosen], SCHEMA)
        return {x.doc_id: (x.kept, x.class_distance) for x in quality.judge(docs).select("_row.doc_id", "kept", "class_distance").collect()}

    alone = kept([x for x in rows if x[0] < 300])
    mixed = kept([x for x in rows if x[0] < 300 or x[0] == 501])
    assert not any(alone[i][0] or mixed[i][0] for i in range(200, 204))
    assert all(mixed[i][0] for i in range(150)) and all(abs(mixed[i][1] - alone[i][1]) < 0.01 for i in range(150))
    assert mixed[200][1] > 0.5


def test_equal_to_sql_with_rare_languages(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in quality.op3_quality_divergence(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.sql(quality.SQL)
    wanted = {x[0]: dict(zip(result.columns, x, strict=True)) for x in result.fetchall()}
    assert found.keys() == wanted.keys()
    for i, w in wanted.items():
        got = found[i].asDict()
        assert {k: v for k, v in got.items() if not k.endswith("distance")} == {k: v for k, v in w.items() if not k.endswith("distance")}, i
        assert all((got[k] is None) == (w[k] is None) and (w[k] is None or abs(got[k] - w[k]) < 2e-6) for k in ("class_distance", "word_distance")), (i, got, w)
    assert all(found[i].kept for i in [*range(150), *range(300, 345), *range(400, 403)])
    assert not any(found[i].kept for i in (*range(200, 204), 500, 503, 504, 505)) and found[502].kept  # too little text of its language
