"""The combined project and the small tables on hand-made rows."""

import json

import pytest

from tessera.operators import combined, funnel, summaries


def source_tables(spark):
    rows = [("b1", 1), ("b1", 2), ("a1", 1), ("a1", 3), ("c1", 9)]
    table = lambda schema, values: spark.createDataFrame([(p, i, *values(p, i)) for p, i in rows], f"project string, report_id long, {schema}")
    return {
        "inventory": table("name string", lambda p, i: (f"report {p} {i}",)),
        "telemetry": table("execs long, last string, tier string", lambda p, i: (i, f"{p}{i}", "exact_id")),
        "features": table("m string, t string, f string", lambda p, i: (f"m{i % 2}", "t", "f")),
    }


def final(spark, rows):
    return spark.createDataFrame(rows, "project string, report_id long")


def test_only_what_drifted_is_copied(spark, tmp_path):
    tables, both = source_tables(spark), combined.Combined(spark, str(tmp_path / "c"))
    first = final(spark, [("b1", 1), ("b1", 2), ("a1", 1)])
    with pytest.raises(ValueError):
        both.run()
    assert {(r.source, r.before is None) for r in both.drifted(first).collect()} == {("b1", True), ("a1", True)}
    assert both.rebuild(first, tables, "t1") == ["a1", "b1"] and both.drifted(first).count() == 0 and both.rebuild(first, tables, "t2") == []
    second = final(spark, [("b1", 2), ("b1", 1), ("a1", 1), ("a1", 3), ("c1", 9)])
    assert both.rebuild(second, tables, "t3") == ["a1", "c1"]
    assert {(r.source, r.reports, r.built_at) for r in both.log().collect()} == {("b1", 2, "t1"), ("a1", 2, "t3"), ("c1", 1, "t3")}
    third = final(spark, [("b1", 1), ("a1", 1), ("a1", 3)])  # one source keeps nothing any more
    assert both.rebuild(third, tables, "t4") == ["b1", "c1"]
    assert {(r.report_id, r.source, r.source_id) for r in both.table("inventory").collect()} == {("b1:1", "b1", "1"), ("a1:1", "a1", "1"), ("a1:3", "a1", "3")}
    assert {r.report_id for r in both.table("features").collect()} == {"b1:1", "a1:1", "a1:3"} and both.table("statements") is None


def test_a_combined_run_knows_its_sources(spark, tmp_path):
    tables, both = source_tables(spark), combined.Combined(spark, str(tmp_path / "c"))
    both.rebuild(final(spark, [("b1", 1), ("a1", 1), ("a1", 3)]), tables, "t1")
    result = both.run()
    found = {(r.source, r.source_id): r.survivor_id for r in both.with_source(result.survivors()).collect()}
    assert found == {("b1", "1"): "a1:3", ("a1", "1"): "a1:3", ("a1", "3"): "a1:3"}  # equal features, the most executed stays


def test_scopes_of_a_run_without_a_stage(spark):
    t = {n: x.drop("project") for n, x in source_tables(spark).items()}
    result = funnel.run_pipeline(t["inventory"].selectExpr("report_id", "'original' AS batch", "name"), t["features"], t["telemetry"])
    ids = lambda n: {r.report_id for r in funnel.scope(result, n).collect()}
    assert ids("post-ast") == {r.report_id for r in result.kept["fingerprint"].collect()} and ids("active") == {1, 2, 3, 9}


def test_paths_features_and_backfill(spark):
    members = spark.createDataFrame([("a", 1, 1, "/own"), ("a", 2, 1, "/x"), ("b", 3, 4, "/late"), ("b", 4, 4, ""), ("b", 2, 4, "/first"), ("c", 5, 5, None)], "group_id string, report_id long, canonical_id long, path string")
    assert {tuple(r) for r in summaries.canonical_paths(members).collect()} == {("a", "/own"), ("b", "/first"), ("c", "")}
    features = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "report_id long, name string")
    found = {r.report_id: r.metrics for r in summaries.with_features(members.select("report_id").distinct(), metrics=features).collect()}
    assert found[1] == ["a", "b"] and found[5] == []
    old = spark.createDataFrame([(1, "metric", "x", "old"), (2, "metric", "x", "old"), (3, "attribute", "x", "old")], "report_id long, kind string, id string, name string")
    fresh = spark.createDataFrame([(1, "metric", [("1", "A"), ("2", "A"), ("3", None), ("4", "B")]), (3, "metric", [])], "report_id long, kind string, items array<struct<id: string, name: string>>")
    out = summaries.replaced_features(old, fresh)
    assert {tuple(r) for r in out.collect()} == {(2, "metric", "x", "old"), (1, "metric", "1", "A"), (1, "metric", "4", "B")}
    assert {tuple(r) for r in summaries.feature_totals(out, "metric").collect()} == {(1, 2), (2, 1)}


def test_sums(spark):
    reports = spark.createDataFrame([(1, "a long report - x", 5, "Public"), (2, "a long report - y", 9, "Other"), (3, "alone", 1, "Public"), (4, "a - b", 1, None)], "report_id long, name string, execs long, place string")
    row = summaries.families(reports).first()
    assert (row.families, row.members, row.reducible, row.consolidated) == (1, 2, 1, 3)
    sized = lambda *n: spark.createDataFrame([(x,) for x in n], "size long")
    assert tuple(summaries.structural_removal(sized(3, 2), sized(5)).first()) == (3, 4, 4)
    assert {tuple(r) for r in summaries.histogram(reports, "place").collect()} == {("Public", 2), ("Other", 1), ("?", 1)}
    users = spark.createDataFrame([(5, False), (7, True), (1, True)], "execs long, service boolean")
    assert tuple(summaries.totals(sized(3, 2), users).first()) == (3, 5, 5, 8, 2)
    assert tuple(summaries.totals(sized(3).limit(0), users.limit(0)).first()) == (0, 0, 0, 0, 0)
    members = spark.createDataFrame([(1, "c", 5), (2, "c", None), (3, "d", 1)], "report_id long, cluster_id string, execs long")
    statements = spark.createDataFrame([(1, "s"), (1, "t"), (3, "")], "report_id long, sql string")
    assert {tuple(r) for r in summaries.statements_per_cluster(members, statements).collect()} == {("c", 1, 5), ("d", 0, 1)}


def test_singletons_and_parents(spark):
    rows = spark.createDataFrame([(1, "a", 5, 1), (2, "b", 9, 2), (3, "c", None, None), (4, "d", 9, 0)], "report_id long, name string, execs long, users long")
    members = spark.createDataFrame([(1,), (1,)], "report_id long")
    assert tuple(summaries.singletons(rows, members).first()) == ("SINGLETONS", 3, 18, 2, "b")
    assert summaries.singletons(rows, rows).count() == 0 and [r.report_id for r in summaries.singleton_list(rows, members, 2).collect()] == [2, 3]
    copies = spark.createDataFrame([(3, 1), (3, 1), (4, 1), (2, 2)], "report_id long, parent_id long")
    assert [tuple(r) for r in summaries.parent_reports(rows, copies).collect()] == [(1, "a", 3, 2, 3), (2, "b", 1, 0, 1)]


def test_stubs_and_definitions(spark):
    texts = [{"id": "1", "owner": {"name": "O", "id": "x"}}, {"objectId": "2", "id": "", "owner": "plain", "type": 3}, {}]
    rows = summaries.stubs(spark.createDataFrame([(json.dumps(t),) for t in texts] + [("broken",)], "value string")).collect()
    assert [(r.id, r.owner) for r in rows] == [("1", "O"), ("2", "plain"), (None, None), (None, None)]
    d = {"information": {"objectId": "i", "name": "n"}, "dataSource": {"filter": {"text": "t", "tree": {"name": "F"}}}}
    row = summaries.definitions(spark.createDataFrame([(json.dumps(d),), ("{}",)], "value string")).first()
    assert (row.id, row.name, row.filter_text, json.loads(row.filter_tree)) == ("i", "n", "t", {"name": "F"})


def test_experiment_rows(spark):
    members = spark.createDataFrame([("X1", 1, [1.0, 0.0]), ("X1", 2, [1.0, 1.0]), ("X2", 3, [0.0, 0.0]), ("X2", 4, [1.0, 0.0])], "id string, report_id long, vector array<float>")
    clusters = spark.createDataFrame([("X1", 1), ("X2", 3)], "id string, primary_id long")
    everyone = spark.createDataFrame([(i, f"n{i}", i, 1) for i in range(1, 7)], "report_id long, name string, execs long, users long")
    found = {r.id: (r.size, r.primary_name, r.execs, r.users, r.least_cosine, r.singletons) for r in summaries.experiment_rows(clusters, members, everyone).collect()}
    assert found == {"X1": (2, "n1", 3, 2, 0.7071, False), "X2": (2, "n3", 7, 2, 1.0, False), "XSING": (2, "n5", 11, 2, None, True)}
    assert "XSING" not in {r.id for r in summaries.experiment_rows(clusters, members, everyone.where("report_id < 5")).collect()}
