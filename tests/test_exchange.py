"""Reviews, trees, comparisons, forest extras, embedding sets and emitted files on hand-made rows."""

import json
import random

import pytest

from tessera.functions.json_tree import names_in
from tessera.operators import comparison, embedding_sets, hierarchy, reviews, similarity
from tessera.plans import condense, cross_emit
from tessera.sources import inventory, json_items

CANONICAL = {"clusterId": "C7", "label": "L", "business_function": "B", "relationship": "R", "consolidation_action": "MERGE", "confidence": "high", "consolidation_detail": "D", "keep_report": "k", "removable_count": 3}
NESTED = {"clusterId": 7, "analysis": {"label": "L", "business_function": "B", "relationship": "R", "action": "MERGE", "confidence": "high", "consolidation_detail": "D", "keep_report": "k", "removable_count": 3}}


def documents(spark, rows):
    return spark.createDataFrame([(p, v if isinstance(v, str) else json.dumps(v)) for p, v in rows], "project string, value string")


def test_both_shapes_give_equal_reviews(spark):
    rows = reviews.imported(documents(spark, [("a", [CANONICAL]), ("b", {"reviews": [NESTED]}), ("c", [NESTED])])).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].cluster_id == "C7" and rows[0].removable_count == 3


def test_odd_reviews(spark):
    docs = documents(spark, [("a", [CANONICAL, {**CANONICAL, "label": "last"}, {"label": "no cluster"}, {"clusterId": "C8"}]), ("a", {"reviews": [{**NESTED, "clusterId": 9}]}), ("b", {"reviews": [{"clusterId": 1}, {"analysis": {}}]}), ("c", "no json"), ("c", "[]"), ("c", "3")])
    found = {(r.project, r.cluster_id): r for r in reviews.imported(docs).collect()}
    assert set(found) == {("a", "C7"), ("a", "C8"), ("b", "C1")}  # canonical reviews of a project stand for all of it
    assert found["a", "C7"].label == "last" and found["b", "C1"].consolidation_action == "" and found["b", "C1"].removable_count == 0
    assert {tuple(r) for r in reviews.action_counts(docs).collect()} == {("a", "MERGE", 2), ("a", "UNKNOWN", 1), ("b", "UNKNOWN", 1)}
    row = reviews.summary(reviews.imported(docs)).first()
    assert (row.reviewed, row.removable, row.safe, row.by_action) == (3, 3, 1, {"MERGE": 1, "UNKNOWN": 2})
    assert reviews.summary(reviews.imported(docs.limit(0))).first().reviewed == 0


def test_similarity_files_of_both_shapes(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"r1|r2": {"combined": 0.9, "metric": 1, "table": 0.5, "filter": 0.25}, "r1|zz": {"combined": 1}, "odd": {"combined": 1}, "r2|r3": {"combined": 0.8, "ast": 0.7}}, indent=1))
    (tmp_path / "l.json").write_text(json.dumps([{"a": "r3", "b": "r1", "score": 0.5}, {"a": None, "b": "r1", "score": 1}, {"a": "r1", "b": "r2", "score": 0.1}]))
    known = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r3",)], "report_id string")
    found = {(r.a, r.b): (r.combined, r.metric, r.ast) for r in reviews.similarity_pairs(json_items.items(spark, str(tmp_path)), known).collect()}
    assert found == {("r1", "r2"): (0.9, 1.0, None), ("r2", "r3"): (0.8, None, 0.7), ("r3", "r1"): (0.5, None, None)}


def test_trees_end_at_cycles_and_count_both_ways(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("x", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("p", "q"), ("q", "p"), (None, "z"), ("s", "s"), ("a", "b")]
    ways = hierarchy.trees(spark.createDataFrame(pairs, "parent string, child string"))
    found = {"/".join(r.path): (r.parent, r.depth) for r in ways.collect()}
    assert found["a/b/c/d/e/f"] == ("e", 5) and found["x/c/b"] == ("c", 2) and "x/c/d/e/f" in found and found["a"] == (None, 0)
    assert not any("p" in k or "s" in k or "z" in k for k in found)
    assert {"/".join(r.path) for r in hierarchy.leaves(ways).collect()} == {"a/b/c/d/e/f", "x/c/b", "x/c/d/e/f"}
    some = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "node string")
    assert {"/".join(r.path) for r in hierarchy.trees(spark.createDataFrame(pairs, "parent string, child string"), some).collect()} == {"a", "a/b", "d", "d/e"}


@pytest.mark.parametrize("kind", ["spread", "ties", "narrow"])
def test_strongest_edges_equal_a_sort(spark, kind):
    r = random.Random(5)
    weight = {"spread": lambda: r.random(), "ties": lambda: r.choice([0.5, 0.5, 0.7, 0.9]), "narrow": lambda: 0.5 + r.random() * 1e-9}[kind]
    edges = [(i, i + 1 + r.randrange(50), weight()) for i in range(3000)]
    table = spark.createDataFrame(edges, "a long, b long, w double")
    for n in (0, 1, 10, 1500, 2999, 5000):
        wanted = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))[:n]
        assert sorted(map(tuple, similarity.strongest(table, n, 8).collect())) == sorted(wanted)


def test_forest_and_extras(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (3, 4, 0.6), (2, 4, 0.5), (1, 4, 0.4)]
    table = spark.createDataFrame(edges, "a long, b long, w double")
    found = {(r.a, r.b): r.extra for r in similarity.forest_and_extras(table, 4).collect()}
    assert found == {(1, 2): False, (2, 3): False, (3, 4): False, (1, 3): True}
    assert {(r.a, r.b) for r in similarity.forest_and_extras(table, 2).collect()} == {(1, 2), (2, 3)}
    assert similarity.forest_and_extras(table, 100).count() == 6


def test_clusterings_side_by_side(spark):
    everyone = spark.createDataFrame([(i, i) for i in range(8)], "report_id long, execs long")
    first = spark.createDataFrame([(0, "j1"), (1, "j1"), (2, "j1"), (3, "j2"), (4, "j2")], "report_id long, cluster_id string")
    second = spark.createDataFrame([(0, "s1"), (1, "s1"), (3, "s1"), (5, "s2"), (6, "s2")], "report_id long, cluster_id string")
    rows = comparison.in_order(comparison.side_by_side(everyone, first, second)).collect()
    assert [r.report_id for r in rows] == [3, 1, 0, 6, 5, 4, 2, 7] and rows[0].jaccard_size == 2 and rows[-1].category == "neither"
    cells = comparison.overlaps(first, second)
    assert {(r.a, r.b): (r.shared, round(r.jaccard, 3)) for r in cells.collect()} == {("j1", "s1"): (2, 0.5), ("j2", "s1"): (1, 0.25)}
    assert {(r.side, r.cluster_id): (r.partner, r.mutual) for r in comparison.partners(cells).collect()} == {("jaccard", "j1"): ("s1", True), ("jaccard", "j2"): ("s1", False), ("semantic", "s1"): ("j1", True)}
    assert tuple(comparison.final_counts(second, everyone).first()) == (2, 5, 3, 5)
    assert tuple(comparison.final_counts(second, everyone.limit(2)).first()) == (2, 5, 0, 2)


def test_embedding_sets(spark, tmp_path):
    sets = embedding_sets.EmbeddingSets(spark, str(tmp_path / "sets"))
    texts = spark.createDataFrame([("r1", "one two"), ("r2", "three"), ("r3", ""), ("r4", None)], "report_id string, text string")
    assert sets.list().count() == 0 and sets.fetch("x") is None and not sets.delete("x") and sets.members("x").count() == 0
    made = sets.save({"name": " a/b = ü ", "project": "p", "scope": "active", "sourceFilter": "cube", "fields": {"sql": True}, "dimensions": 8}, texts, "2024-01-01")
    assert (made["report_count"], made["token_estimate"], made["version"], made["created_at"], made["fields"]) == (2, 3, 1, "2024-01-01", {"sql": True})
    sets.save({"name": "other", "project": "q"}, texts.limit(1), "2024-01-02")
    again = sets.save({"name": "a/b = ü", "project": "p", "dimensions": 16}, texts.limit(1), "2024-01-03")
    assert (again["version"], again["created_at"], again["refreshed_at"], again["report_count"], again["scope"]) == (2, "2024-01-01", "2024-01-03", 1, "post-family")
    assert [r.name for r in sets.list().collect()] == ["a/b = ü", "other"] and [r.name for r in sets.list("q").collect()] == ["other"]
    assert {r.report_id for r in sets.members("a/b = ü").collect()} == {"r1"}
    config = {"threshold": 0.9, "model": "mine", "embeddingSetName": "other"}
    assert sets.resolve(config) == {"threshold": 0.9, "embeddingSetName": "other", "project": "q", "scope": "post-family", "sourceFilter": "all", "model": "terms", "dimensions": 256, "fields": {}, "resolvedFrom": "other"}
    assert sets.resolve({"model": "m"}) == {"model": "m"} and sets.resolve({"embeddingSetName": "none"}) == {"embeddingSetName": "none"}
    assert sets.delete("other") and sets.fetch("other") is None and sets.members("other").count() == 0 and sets.fetch("a/b = ü")
    for bad in ({"name": " "}, {"name": "empty"}):
        with pytest.raises(ValueError):
            sets.save(bad, texts.limit(0), "now")


def test_cross_files_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cross_emit, "MEMBERS_A_ROW", 4)
    rows = [("common", f"p{i % 3}", i, f"N{i}", "/x", i) for i in range(11)] + [("two", "p1", 20, None, None, None), ("two", "p2", 21, "T", "/y", 5), ("alone", "p1", 30, "A", "", 1), ("alone", "p1", 31, "A", "", 1), (None, "p1", 40, "", "", 0), (None, "p2", 41, "", "", 0)]
    names = spark.createDataFrame(rows, "key string, project string, report_id long, name string, path string, executions long")
    keys = names.select("key", "project")
    made = cross_emit.tables(names, names.select("key", "project", "report_id"), keys, keys, keys, keys.select("project"))
    cross_emit.write(made, str(tmp_path))
    back = spark.read.json(f"{tmp_path}/name_matches").collect()
    assert sorted((r.id, r.part, len(r.members), r.nProjects, r.nReports) for r in back) == [("NM00001", 0, 4, 3, 11), ("NM00001", 1, 4, 3, 11), ("NM00001", 2, 3, 3, 11), ("NM00002", 0, 2, 2, 2)]
    members = inventory.load_emitted(spark, f"{tmp_path}/name_matches", ["report_id", "name"], "members")
    assert {(r.group_id, r.report_id) for r in members.collect()} == {("NM00001", i) for i in range(11)} | {("NM00002", 20), ("NM00002", 21)}
    assert {(r.sqlHash, r.id) for r in spark.read.json(f"{tmp_path}/sql_matches").collect()} == {("common", "SH00001"), ("two", "SH00002")}
    assert [tuple(r) for r in made["shared_tables"].collect()] == [("common", 3, 11, ["p0", "p1", "p2"]), ("two", 2, 2, ["p1", "p2"])]
    assert tuple(spark.read.json(f"{tmp_path}/summary").select("nameMatches", "sqlMatches", "sharedTables", "sharedMetrics", "sharedFamilies", "projects").first()) == (2, 2, 2, 2, 2, ["p0", "p1", "p2"])


def test_context_keeps_to_its_size(spark):
    reports = spark.createDataFrame([(i, "n" * 30, ["", "cube", None][i % 3], ["active", None, "retired"][i % 3], i % 2 == 0, i) for i in range(200)], "id long, name string, source_type string, status string, final boolean, weight long")
    groups = spark.createDataFrame([(i, "g", i, i - 1) for i in range(40)], "id long, name string, weight long, reducible long")
    whole = condense.condensed(reports, groups, groups, groups).first()
    assert [x["id"] for x in json.loads(whole.finalKeptTop)] == list(range(198, 98, -2)) and len(json.loads(whole.familyTop)) == 15 and len(json.loads(whole.jaccardTopClusters)) == 20
    assert whole.overall == {"unknown": 133, "cube": 67} and whole.statusBreakdown == {"active": 134, "retired": 66} and whole.finalKeptCount == 100 and whole.familyCount == 40
    small = condense.condensed(reports, groups, groups, groups, budget=1500).first()
    lists = [json.loads(small[c]) for c in condense.MOST]
    assert sum(len(small[c]) for c in condense.MOST) < 1510 and min(map(len, lists)) > 3
    assert [x["id"] for x in lists[0]] == [198 - 2 * i for i in range(len(lists[0]))]
    none = condense.condensed(reports.limit(0), groups.limit(0), groups, groups).first()
    assert none.finalKeptTop == "[]" and none.finalKeptCount == 0


def test_names_at_any_depth(spark):
    deep = "x"
    for _ in range(400):
        deep = {"name": "d", "k": [deep]}
    rows = [(1, json.dumps({"name": "A", "b": [{"name": "B"}, [{"c": {"name": "C", "name2": 1}}]], "n": {"name": 5}})), (2, None), (3, "{broken"), (4, '["name"]'), (5, json.dumps(deep)), (6, '{"name": ""}')]
    found = names_in(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    assert {(r.path, r.depth, r.name) for r in found.where("id = 1").collect()} == {("$", 1, "A"), ("$.b[0]", 3, "B"), ("$.b[1][0].c", 5, "C")}
    assert found.groupBy("id").count().where("id <> 1").collect() == [(5, 400)]


def test_fields_of_a_record(spark, tmp_path):
    record = {"id": "r", "metrics": [{"id": "1", "name": "M"}, {"id": "2", "name": ""}, {"id": "1", "name": "M"}], "attributes": [{"id": "a", "name": "X"}, {"id": "b", "name": "X"}], "sourceTables": ['"S"."T_V"', "s.t_v", ""], "filter": {"tree": {"name": "F", "kids": [{"form": {"name": "G"}}, {"name": "f"}]}, "text": "t"}}
    (tmp_path / "r.json").write_text(json.dumps([record, {**record, "id": "s", "filter": {"tree": ["name"]}, "metrics": None}]))
    found = inventory.fields_of(inventory.read_inventory(spark, str(tmp_path / "r.json"), lines=False))
    rows = {(r.report_id, r.kind, r.id, r.name) for r in found.collect()}
    assert {x[1:] for x in rows if x[0] == "r"} == {("metric", "1", "M"), ("table", None, '"t_v'), ("table", None, "t_v"), ("attribute", "b", "X"), ("filter", None, "f"), ("filter", None, "g")}
    assert {x[1] for x in rows if x[0] == "s"} == {"table", "attribute"}


def test_items_know_their_depth(spark, tmp_path):
    (tmp_path / "a.json").write_text('[] [ ] [{"a":1}, {"a":2}] [] [{"a":3}]')
    (tmp_path / "o.json").write_text('{}{"x":{"a":1},"y":{"a":{"b":2}}}{"z":{}}')
    assert [r.value for r in json_items.items(spark, str(tmp_path / "a.json")).orderBy("split", "item").collect()] == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert [r.value for r in json_items.items(spark, str(tmp_path / "o.json")).orderBy("split", "item").collect()] == ['"x":{"a":1}', '"y":{"a":{"b":2}}', '"z":{}']


def test_a_document_is_read_once_not_for_each_of_its_reviews(spark):
    value = json.dumps({"reviews": [{"clusterId": i, "analysis": {"label": f"l{i}"}} for i in range(50)]})
    docs = spark.createDataFrame([("p", value), ("q", json.dumps([{"clusterId": "x"}])), ("r", "no json")], "project string, value string")
    found = reviews.reviews_of(docs)
    above, generate, _ = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert generate and "$.reviews" not in above
    assert sorted((r.project, r.place, r.cluster_id, r.shape) for r in found.collect()) == sorted([("p", i, f"C{i}", "nested") for i in range(50)] + [("q", 0, "x", "canonical")])


def test_trees_have_no_limit_of_rows(spark):
    pairs = [("r", f"a{i}") for i in range(20)] + [(f"a{i}", f"b{i}") for i in range(20)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        ways = hierarchy.trees(spark.createDataFrame(pairs, "parent string, child string")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(ways) == 41 and sum(w.depth == 2 for w in ways) == 20
