"""Shares, samples, placed members, merges and representatives on hand-made rows."""

from tessera.operators import dedup, syntax, usage, views
from tessera.sources import inventory


def test_shares_and_frequency(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    assert {tuple(r) for r in usage.shares(rows, "c").collect()} == {("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)}
    assert [tuple(r) for r in usage.frequency(rows, "c", 1).collect()] == [("a", 2)] and usage.frequency(rows, "c").count() == 3


def test_samples_and_places(spark):
    rows = spark.createDataFrame([("g", i, f"n{i}", i) for i in range(30)] + [("h", 50, "alone", None)], "grp string, report_id long, name string, execs long")
    lines = {r.grp: r.lines for r in views.sampled_members(rows, "grp", 3).collect()}
    assert lines == {"g": ["n29", "n28", "n27", "+27 more"], "h": ["alone"]}
    best = rows.selectExpr("*", "CASE WHEN grp = 'g' THEN 4 ELSE 50 END AS primary")
    placed = {(r.grp, r.place): r.report_id for r in views.ordered_members(best, "grp", "primary").collect()}
    assert placed["g", 1] == 4 and placed["g", 2] == 29 and placed["g", 30] == 0 and placed["h", 1] == 50


def test_merges_take_defined_rows(spark):
    old = spark.createDataFrame([(1, "old")], "report_id long, name string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (3, None)], "report_id long, name string")
    assert {tuple(r) for r in dedup.merged_inventory(old, new).collect()} == {(1, "old"), (2, "a"), (3, None)}
    assert {tuple(r) for r in dedup.representatives(new, "name").collect()} == {("new", 1, 1), ("b", 2, 1), ("a", 2, 1)}


def test_what_is_still_to_be_asked_for(spark):
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "report_id long")
    assert {r.report_id for r in inventory.to_recover(ids(1, 2, 3, 3, 4), ids(2), ids(4)).collect()} == {1, 3}


def test_paths(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "a", "path": "/x"}\n{"id": "", "path": "/y"}\n{"id": "b"}\n{"id": "c", "path": ""}\n')
    assert [tuple(r) for r in inventory.read_paths(spark, str(tmp_path / "p.json")).collect()] == [("a", "/x")]


def test_deep_statements_differ_by_what_is_deep():
    deep = lambda x: "select a from " + "(select b from " * 60 + x + ")" * 60
    assert syntax.subtree_hashes([deep("t")]) == syntax.subtree_hashes([deep("t")]) != syntax.subtree_hashes([deep("u")])
