"""The funnel, syntax shapes, vectors and sources on hand-made rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import funnel, match, similarity, syntax, usage, vectors, views
from tessera.operators.graph import connected_components, star_components
from tessera.plans import emit
from tessera.plans.grid import predicate
from tessera.sources import inventory


def test_shapes_do_not_depend_on_literals_aliases_and_order():
    a = syntax.subtree_hashes(["SELECT a.x, sum(b.y) s FROM t1 a JOIN s.t2 b ON a.id = b.id WHERE a.k = 'foo' AND b.z > 10 GROUP BY a.x"])
    b = syntax.subtree_hashes(["select q.x, sum(w.y) as tot from T1 q join t2 w on q.id = w.id where w.z > 99 and q.k = 'bar' group by q.x"])
    c = syntax.subtree_hashes(["select q.x from T1 q where q.k in (select k from z where a between 1 and 2 or not b is null)"])
    assert a == b and a != c and set(a) & set(c)
    assert len(syntax.subtree_hashes(["SELECT a FROM t WHERE b = 'x' AND c = 1"])) == 12  # a, t, b, c, literal, two comparisons, and, three clauses, query


def test_any_text_has_a_shape():
    r = random.Random(1)
    words = "select from where ( ) , a b.c 'x' 1 and or not in between case when then else end as join on group by order with union all = < + - * over partition insert into ; .".split()
    for _ in range(1500):
        syntax.subtree_hashes([" ".join(r.choices(words, k=r.randint(0, 40)))])
    for odd in ("(" * 3000, "select " + "f(" * 2000, "select " + "not " * 2000, "select a from " + "(" * 2000, "select " + "case when " * 2000, "select a where " + " and ".join(f"x{i} = 1" for i in range(2000)), ""):
        syntax.subtree_hashes([odd])


def test_hashes_of_known_reports_stay(spark):
    rows = spark.createDataFrame([(1, "select a from t"), (2, "select b from t"), (3, ""), (4, None)], "report_id long, sql string")
    known = spark.createDataFrame([(1, ["old"])], "report_id long, hashes array<string>")
    found = {r.report_id: r.hashes for r in syntax.hash_statements(rows, known).collect()}
    assert found[1] == ["old"] and len(found[2]) > 3 and set(found) == {1, 2}


def small_run(spark, **options):
    names = ["a long report - x", "a long report - y", "b", "b", "c", None, "d", "e"]
    inv = spark.createDataFrame([(i, ["original", "old"][i == 7], n, "/Public/x") for i, n in enumerate(names)], "report_id long, batch string, name string, path string")
    tele = spark.createDataFrame([(i, e, str(i), "exact_id") for i, e in enumerate([5, 9, 3, 4, 2, 8, 0, 6])], "report_id long, execs long, last string, tier string")
    feats = spark.createDataFrame([(i, m, t, "f") for i, (m, t) in enumerate([("m1", "t1"), ("m2", "t2"), ("m3", "t3"), ("m3", "t3"), ("m9", "t9"), ("m9", "t9"), ("x", "y"), ("x", "y")])], "report_id long, m string, t string, f string")
    sql = spark.createDataFrame([(0, "select 1 from a"), (2, "select 2 from b -- x"), (4, "select 3 from b")], "report_id long, sql string")
    return inv, feats, funnel.run_pipeline(inv, feats, tele, sql, **options)


@pytest.mark.parametrize(("mode", "left"), [("reference", {0}), ("sequential", {0, 2})])
def test_statement_groups_by_mode(spark, mode, left):
    """Equal features take 1 for 0; of the equal statements of 1, 2 and 3 the group over all elects 1, which is gone, and the group of survivors elects 2."""
    inv = spark.createDataFrame([(i, "original", n) for i, n in enumerate(["p one", "x two", "z three", "w four"])], "report_id long, batch string, name string")
    tele = spark.createDataFrame([(0, 20, "a", "exact_id"), (1, 10, "b", "exact_id"), (2, 4, "c", "exact_id"), (3, 3, "d", "exact_id")], "report_id long, execs long, last string, tier string")
    feats = spark.createDataFrame([(0, "m", "t", "f"), (1, "m", "t", "f"), (2, "m2", "t2", "f2"), (3, "m3", "t3", "f3")], "report_id long, m string, t string, f string")
    sql = spark.createDataFrame([(i, "select 1 from a") for i in (1, 2, 3)], "report_id long, sql string")
    run = funnel.run_pipeline(inv, feats, tele, sql, mode=mode)
    assert {r.report_id for r in run.kept["sql_hash"].collect()} == left


@pytest.mark.parametrize("mode", ["reference", "sequential"])
def test_stages_follow_each_other(spark, tmp_path, mode):
    inv, feats, run = small_run(spark, mode=mode)
    kept = {k: {r.report_id for r in v.collect()} for k, v in run.kept.items()}
    assert kept["universe"] == {0, 1, 2, 3, 4, 5}
    assert kept["fingerprint"] == {0, 1, 3, 5}  # 2 goes to 3, 4 to 5
    assert kept["family"] == {1, 3, 5}
    chain = {r.report_id: (r.survivor_id, r.stage) for r in run.survivors().collect()}
    assert chain[0] == (1, "family") and chain[2] == (3, "fingerprint") and chain[6] == (None, "telemetry") and chain[5] == (5, None)
    status = {r.report_id: r.status for r in emit.reports(run, feats).collect()}
    assert status == {0: "collapsed", 1: "active", 2: "collapsed", 3: "active", 4: "collapsed", 5: "active", 6: "retired", 7: "retired"}
    emit.write(run, feats, str(tmp_path), ["old"])
    back = inventory.load_emitted(spark, f"{tmp_path}/reports", ["report_id", "name", "status"])
    assert {r.report_id for r in back.collect()} == set(range(8))
    assert {r.bucket for r in emit.retired(run, ["old"]).collect()} == {"batch", "telemetry"}
    words = {r.report_id: r.why for r in funnel.why(run, inv.where("report_id = 0"), inv.where("report_id = 1")).collect()}
    assert words[0] == "retained by a user" and words[1] == "retired by a user" and words[6] == "not used" and words[2] == "collapsed by fingerprint"


def test_an_empty_inventory_runs(spark):
    inv, feats, _ = small_run(spark)
    empty = funnel.run_pipeline(inv.limit(0), feats.limit(0), spark.createDataFrame([], "report_id long, execs long, last string, tier string"))
    assert empty.final.count() == 0 and empty.survivors().count() == 0


def test_similarity_uses_shapes_on_both_sides(spark):
    rows = [(0, ["a"], ["t"], ["f"], ["h1", "h2"]), (1, ["a"], ["t"], ["g"], ["h1", "h2"]), (2, ["a"], ["t"], ["f"], []), (3, ["b"], ["t"], ["f"], ["h1", "h2"])]
    sets = spark.createDataFrame(rows, "id long, m array<string>, t array<string>, f array<string>, x array<string>")
    found = {(r.a, r.b): round(r.score, 6) for r in similarity.weighted_set_join(sets).collect()}
    assert found == {(0, 1): 1.0, (0, 2): 1.0, (1, 2): 0.8}


def test_set_join_equals_all_pairs(spark):
    r = random.Random(4)
    sets = [sorted({f"e{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randint(0, 9))}) for _ in range(150)]
    found = {(x.a, x.b) for x in similarity.set_join(spark.createDataFrame(list(enumerate(sets)), "id long, s array<string>"), "id", "s", 0.6).collect()}
    expected = {(i, j) for i in range(150) for j in range(i + 1, 150) if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j])))}
    assert found == expected


def test_stars_and_link_counts_equal_all_pairs(spark):
    r = random.Random(9)
    for least, most in ((0.8, 22), (0.5, 9)):
        base = [{r.randrange(40) for _ in range(r.randint(0, most))} for _ in range(40)]
        sets = [*base, *[b ^ {r.randrange(40) for _ in range(r.choice([1, 1, 2, 4]))} for b in base for _ in range(3)]]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
        rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id long, s array<string>")
        assert {(x.a, x.b) for x in similarity.set_join(rows, "id", "s", least).collect()} == set(pairs)
        expected = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
        assert sorted(star_components(similarity.set_stars(rows, "id", "s", least), "a", "b").collect()) == sorted(expected)
        links = {i: sum(i in p for p in pairs) for i in range(len(sets))}
        assert {x.id: x.links for x in similarity.set_link_counts(rows, "id", "s", least).collect()} == {i: n for i, n in links.items() if n}


def test_sets_without_a_rare_element_make_few_rows(spark):
    """Six of 18 names in all ways: by their rarest elements most pairs would meet, by common subsets only the alike."""
    rows = spark.createDataFrame([(i, [str(x) for x in c]) for i, c in enumerate(itertools.combinations(range(18), 6))], "id long, s array<string>")
    assert similarity.subsets(similarity.hashed_sets(rows, "id", "s"), 0.8).count() == 7 * rows.count()
    assert similarity.set_stars(rows, "id", "s", 0.7).count() <= 7 * rows.count()
    assert {x.links for x in similarity.set_link_counts(rows, "id", "s", 0.7).collect()} == {6 * 12}


def test_forests_of_blocks_hold_the_forest_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    monkeypatch.setattr(similarity, "LARGE_BLOCK", 40)
    monkeypatch.setattr(similarity, "BLOCKS", 1)
    monkeypatch.setattr(similarity, "TILE", 7)
    x = np.random.default_rng(3).integers(-2, 3, (120, 4)).astype(float)  # many equal cosines
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pairs = similarity.cosine_join(rows, "id", "v", 0.5).withColumn("cosine", F.round("cosine", 9)).collect()
    root, expected = list(range(120)), set()
    for r in sorted(pairs, key=lambda r: (-r.cosine, r.a, r.b)):
        p, q = root[r.a], root[r.b]
        if p != q:
            expected.add((r.a, r.b))
            root = [p if t == q else t for t in root]
    assert {(a, b) for a, b in np.array([(r.a, r.b) for r in pairs])[similarity.forest_of(*(np.array(c) for c in zip(*pairs, strict=True)))].tolist()} == expected
    some = similarity.cosine_forests(rows, "id", "v", 0.5)
    assert some.count() < len(pairs) / 2
    assert sorted(connected_components(some, "a", "b").collect()) == sorted(connected_components(spark.createDataFrame(pairs), "a", "b").collect())
    forest = similarity.spanning_forest(spark.createDataFrame(pairs).withColumnRenamed("cosine", "w")).collect()
    assert {(r.a, r.b) for r in forest} == expected
    totals = similarity.cosine_totals(rows, "id", "v", 0.5).collect()
    assert {r.a: r.links for r in totals} == {a: sum(r.a == a for r in pairs) for a in {r.a for r in pairs}}


def test_silhouette_on_a_line_equals_all_pairs(spark):
    r = random.Random(6)
    rows = [(i, r.choice([0, 0, 1, 2, -1]), float(r.choice([r.randrange(9), r.gauss(0, 50)]))) for i in range(300)] + [(900, 7, 3.0)]
    points = spark.createDataFrame(rows, "id long, cluster int, x double").withColumn("z", F.lit(0.0))
    expected = vectors.silhouette(points, ["x", "z"]).first()[0]
    assert vectors.silhouette(points, ["x"]).first()[0] == pytest.approx(expected, abs=1e-9)
    known = points.where("cluster <> -1").select(F.col("cluster").alias("c"), "x")
    assert vectors.silhouette_line(known, 90000).first()[0] == pytest.approx(expected, abs=1e-9)  # five ranges
    plan = vectors.silhouette(points, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "total_before" in plan  # no distances of pairs are taken


def test_fuzzy_match_has_floor_and_boost(spark):
    left = spark.createDataFrame([(1, "daily sales", None), (2, "alpha beta gamma delta", "/p/"), (3, "single", None), (4, "no such thing here", None)], "id long, name string, path string")
    right = spark.createDataFrame([(10, "big daily sales report of all stores", None), (20, "Alpha beta other words", "P"), (30, "single", None)], "id long, name string, path string")
    found = {r.id: (r.match, round(r.score, 6)) for r in match.fuzzy(left, right, 0.45).collect()}
    assert found == {1: (10, 0.7), 2: (20, round(2 / 6 + 0.15, 6))}


def test_match_by_name_retires_old_and_unknown(spark):
    inv = spark.createDataFrame([(1, "A  b"), (2, "c"), (3, "")], "report_id long, name string")
    act = spark.sql("SELECT '*a b' AS name, 3L AS execs, TIMESTAMP '2024-01-01' AS last UNION ALL SELECT 'c', 1L, TIMESTAMP '2020-01-01' UNION ALL SELECT '', 9L, TIMESTAMP '2024-01-01'")
    found = {r.report_id: (r.matched, r.execs, r.retire) for r in match.by_name(inv, act, "2024-06-01").collect()}
    assert found == {1: (True, 3, False), 2: (True, 1, True), 3: (False, 0, True)}


def test_projection_equals_singular_vectors(spark):
    x = np.random.default_rng(2).normal(size=(60, 5)) * [5, 3, 1, 1, 0.5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = np.array([(r.x0, r.x1) for r in vectors.projected(rows, "id", "v").orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    own = u[:, :2] * s[:2]
    own = (own - own.min(axis=0)) / (own.max(axis=0) - own.min(axis=0))
    for k in (0, 1):
        assert np.allclose(found[:, k], own[:, k], atol=1e-8) or np.allclose(found[:, k], 1 - own[:, k], atol=1e-8)


def test_density_finds_blobs_and_noise(spark):
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(0, 0.1, (40, 2)), r.normal(3, 0.1, (40, 2)), r.uniform(-20, 20, (10, 2))])
    labels = vectors.density_clusters(x)
    assert len(set(labels[:40].tolist()) - {-1}) == 1 and len(set(labels[40:80].tolist()) - {-1}) == 1 and labels[0] != labels[40]
    assert (labels[80:] == -1).sum() >= 8 and (vectors.density_clusters(x[:10]) == -1).all()


def test_average_linkage_equals_brute_force(spark):
    r = np.random.default_rng(5)
    x = np.vstack([c + r.normal(0, 0.25, (8, 6)) for c in r.normal(0, 1, (4, 6))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = {a.id: a.cluster for a in vectors.linked(rows, "id", "v", 0.3).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d, i, j = min((np.mean([1 - y[a] @ y[b] for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i))
        if d > 0.3:
            break
        groups[j] += groups.pop(i)
    assert found == {i: min(g) for g in groups for i in g}


def test_cache_holds_what_was_embedded(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], "report_id long, text string")
    none = spark.createDataFrame([], "report_id long, model string, content_hash string, vector array<float>")
    cache = vectors.embedded(texts, none, "m", 8)
    more = spark.createDataFrame([(1, "a b"), (2, "changed")], "report_id long, text string")
    assert vectors.probe(more, cache, "m", 8, 0.1).first()[:4] == (2, 1, 1, 1)
    assert vectors.embedded(more, cache, "m", 8).count() == 4


def test_upserts_say_which_row_wins(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k long, v string, t int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "d", 1), (2, "e", 2)], "k long, v string, t int")
    assert {(r.k, r.v) for r in inventory.first_wins(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "d")}
    assert {(r.k, r.v) for r in inventory.last_wins(old, new, ["k"], "t").collect()} == {(1, "c"), (2, "e")}
    assert inventory.audit("x", new, old).first()[:] == ("x", 4, 1)


def test_definition_units_of_both_forms(spark):
    rows = [(1, [("1", "Sales", "metric", "attribute", []), ("2", "Region", None, "attribute", []), ("g", "all", None, "metrics", [("3", None, "Cost", None), (None, "4", "Rate", "x")])])]
    d = spark.createDataFrame(rows, f"report_id long, units {inventory.UNITS}")
    assert {(r.kind, r.id, r.name) for r in inventory.definition_units(d).collect()} == {("metric", "1", "Sales"), ("attribute", "2", "Region"), ("metric", "3", "Cost"), ("metric", "4", "Rate")}


def test_grid_becomes_a_table(spark):
    grid = spark.createDataFrame([(0, [1, 0], [["a", "b"], ["x"]], [1.5], ["$1.50"]), (1, [0, 0], [["a", "b"], ["x"]], [2.5], [None])], "row int, header_index array<int>, elements array<array<string>>, raw array<double>, formatted array<string>")
    assert sorted(map(tuple, inventory.grid_table(grid).collect())) == [(0, 0, "b"), (0, 1, "x"), (0, 2, "$1.50"), (1, 0, "a"), (1, 1, "x"), (1, 2, "2.5")]


@pytest.mark.parametrize(("operator", "value", "expected"), [("Equals", "ab", 1), ("NotEqual", "ab", 2), ("Greater", "ab", 2), ("Less", "b", 2), ("GreaterEqual", "ab", 3), ("LessEqual", "ab", 1), ("BeginsWith", "a", 2), ("Contains", "c", 2), ("Like", "_c", 2), ("In", ["ab", "bc"], 2), ("NotIn", ["ab"], 2)])
def test_each_filter_operator(spark, operator, value, expected):
    rows = spark.createDataFrame([("ab",), ("ac",), ("bc",)], "x string")
    assert rows.where(predicate(F.col("x"), operator, value)).count() == expected


def test_lists_of_clusters_and_members(spark):
    rows = spark.createDataFrame([(1, "x", [("needle", "p")], None), (2, "y", [("hay", "q")], "KEEP_SEPARATE")], "id long, name string, members array<struct<name: string, path: string>>, action string")
    assert [r.id for r in views.clusters_matching(rows, "NEEDLE", ["name"], "members", ["name", "path"]).collect()] == [1]
    assert [r.id for r in views.clusters_matching(rows, "", ["name"], "members", ["name"], "UNKNOWN").collect()] == [1]
    statements = spark.createDataFrame([(1, "select"), (2, "")], "report_id long, sql string")
    members = spark.createDataFrame([(1,), (2,), (3,)], "report_id long")
    assert [views.with_statement(members, statements, x).count() for x in (True, False)] == [1, 2]
    state, other = usage.toggle(members.where("report_id = 1"), members, members.where("report_id = 2"), True)
    assert sorted(r.report_id for r in state.collect()) == [1, 2] and sorted(r.report_id for r in other.collect()) == [1, 3]


@pytest.mark.parametrize(("given", "expected"), [(None, ""), ("null", ""), ('"a"', "a"), ("a", "a"), ('{"id": "7"}', "7"), ('["a", {"name": "b"}, null]', "a/b"), ("12", "12")])
def test_plain_text_of_json(spark, given, expected):
    assert spark.range(1).select(text.plain(F.lit(given).cast("string"))).first()[0] == expected


def test_literals_with_comment_signs(spark):
    sql = "SELECT '--x', 'it''s' FROM dss_int7 a JOIN my_temp_1 b -- end"
    row = spark.range(1).select(text.sql_for_hash(F.lit(sql)).alias("h"), text.sql_for_vectors(F.lit(sql)).alias("v")).first()
    assert row.h == "select '" and row.v == "select ?, ? from tmp_tbl a join tmp_tbl b"
