"""The engine's operators on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cross_project, dedup, lineage, match, similarity
from tessera.operators.graph import connected_components
from tessera.operators.ranking import numbered, placed, primary_first
from tessera.sources import projects


def value(spark, column, **row):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (text.norm_name, "  Daily   Sales ", "daily sales"),
        (text.norm_activity_name, "*Daily*Sales", "daily sales"),
        (text.norm_starred_name, "**Daily  Sales", "daily sales"),
        (text.norm_table, '"SCH"."T_V"', '"t_v'),
        (text.family_base, "Projections by PD - North", "Projections by PD"),
        (text.family_base, "Sales - North", "Sales - North"),
        (text.family_base, "Projections - PD - North", "Projections - PD"),
        (text.sql_for_hash, "SELECT a FROM ZZT12 -- x\n WHERE b='k' AND c=12.5", "select a from ZTMP where b='?' and c=0"),
        (text.sql_for_vectors, "SELECT '--x', 10 FROM zzmd00 /* c */", "select ?, ? from tmp_tbl"),
        (text.tables_of, "select * from a.b join [c] on 1=1 from a.b", ["a.b", "c"]),
    ],
)
def test_scalars(spark, function, given, expected):
    assert value(spark, function(F.col("x")), x=given) == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 101), (7, 7)]
    found = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert found == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_spanning_forest(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (7, 8, 0.95)], "a long, b long, w double")
    assert sorted(map(tuple, similarity.spanning_forest(edges).collect())) == [(1, 2, 0.9), (2, 3, 0.8), (7, 8, 0.95)]


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_weighted_join_equals_all_pairs(spark):
    r = random.Random(1)
    triples = {tuple(frozenset(r.sample("abcdef", r.randint(0, 4))) for _ in range(3)) for _ in range(120)}
    rows = [(i, *[sorted(s) for s in t]) for i, t in enumerate(triples)]
    sets = [(i, *map(set, t)) for i, *t in rows]
    expected = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and 0.4 * jaccard(a[1], b[1]) + 0.4 * jaccard(a[2], b[2]) + 0.2 * jaccard(a[3], b[3]) >= 0.8}
    found = similarity.weighted_set_join(spark.createDataFrame(rows, "id long, m array<string>, t array<string>, f array<string>"))
    assert {(x.a, x.b) for x in found.collect()} == expected


def test_fingerprint_gate_and_canonical(spark):
    rows = [("a", 5, ["m1", "m2"], ["t1"], []), ("b", 9, ["m1", "m2"], ["t1"], []), ("c", 1, ["m1"], ["t1"], []), ("d", 3, [], [], []), ("e", 2, [], [], [])]
    sets = spark.createDataFrame(rows, "report_id string, execs long, m array<string>, t array<string>, f array<string>")
    members = dedup.fingerprint(sets)
    assert {(x.report_id, x.canonical_id) for x in members.collect()} == {("a", "b"), ("b", "b")}
    assert {x.report_id for x in dedup.survivors(sets, members).collect()} == {"b", "c", "d", "e"}


def test_collisions(spark):
    rows = [("r1", "Sales A", 10, "t1", "exact_id"), ("r2", "sales  a", 10, "t1", "exact_id"), ("r3", "Other", 10, "t2", "exact_id"), ("r4", "Third", 10, "t2", "exact_id"), ("r5", "Third", 10, "t3", "exact_id"), ("r6", "Solo", 0, None, "none")]
    found = dedup.collisions(spark.createDataFrame(rows, "report_id string, name string, execs long, last string, tier string"))
    assert {x.report_id for x in found.collect() if x.report_id != x.canonical_id} == {"r2", "r5"}


def test_waterfall(spark):
    inventory = spark.createDataFrame([("i1", "X", "p/a"), ("i2", "Y", "p/b"), ("i3", "Z", "p/c"), ("i4", "Y", "p/zzz"), ("o1", "Q", "p/q")], "report_id string, name string, path string")
    activity = spark.createDataFrame([("o1", "X", "p/q", 5), ("o2", "Y", "p/b", 7), ("o3", "z", "p/other", 3)], "object_id string, name string, path string, execs long")
    found = {x.report_id: (x.tier, x.execs) for x in match.waterfall(inventory, activity).collect()}
    assert found == {"o1": ("exact_id", 5), "i2": ("full_path", 7), "i3": ("exact_name", 3), "i4": ("none", 0), "i1": ("none", 0)}


def test_numbered(spark):
    out = numbered(spark.range(1000).repartition(7), "n", F.desc("id"))
    assert all(x.n == 1000 - x.id for x in out.collect())


def test_collisions_keep_different_executions_and_unused_reports(spark):
    rows = [("r1", "Sales", 10, "t1", "exact_id"), ("r2", "Sales", 20, "t2", "exact_id"), ("r3", "Sales", 20, "t3", "exact_id"), ("r4", "Idle", 0, None, "none"), ("r5", "Idle", 0, None, "none")]
    found = dedup.collisions(spark.createDataFrame(rows, "report_id string, name string, execs long, last string, tier string"))
    assert {(x.report_id, x.canonical_id, x["pass"]) for x in found.collect()} == {("r1", "r1", 0), ("r2", "r2", 0), ("r3", "r2", 2), ("r4", "r4", 0), ("r5", "r5", 0)}


def test_source_groups(spark):
    rows = [(1, "cube", "c1"), (1, "table", "t1"), (1, "table", "t2"), (1, "prompt", "p"), (2, None, None), (1, "filter", "f")]
    found = lineage.source_groups(spark.createDataFrame(rows, "report_id long, type string, name string"), ["table", "cube"])
    assert sorted((r.place, r.label) for r in found.where("report_id = 1").collect()) == [(1, "tables (2)"), (2, "c1"), (3, "f"), (4, "p")]
    assert [(r.place, r.label, r.objects) for r in found.where("report_id = 2").collect()] == [(1, None, 1)]
    assert lineage.source_groups(found.select("report_id", "type", F.col("label").alias("name")).limit(0), []).count() == 0


def test_project_references():
    known = [projects.Project("north", "North America", "G1"), projects.Project("south", "South America", "G2"), projects.Project("G1", "north")]
    assert [projects.by_reference(known, x).project_id for x in (" south ", "G2", "south america", "north", "G1")] == ["south", "south", "south", "north", "G1"]
    assert [projects.by_name(known, name=x).project_id for x in ("north", "NORTH", "South", "north a")] == ["G1", "G1", "south", "north"]
    assert projects.by_name(known, "SOUTH", "ignored").project_id == "south"
    assert projects.by_name(known[:1]).project_id == "north"
    for wrong in ({"name": "america"}, {"name": "west"}, {"project_id": "west"}, {}):
        with pytest.raises(LookupError):
            projects.by_name(known, **wrong)
    with pytest.raises(LookupError):
        projects.by_reference(known, "west")
    with pytest.raises(ValueError):
        projects.by_reference(known, "  ")


def test_shared_by_projects(spark):
    rows = spark.createDataFrame([("k", "B"), ("k", "A"), ("k", "B"), ("own", "A"), ("own", "A"), (None, "A"), (None, "B"), ("", "A"), ("", "B")], "name string, project string")
    assert [tuple(r) for r in cross_project.shared(rows, "name").collect()] == [("k", 2, 3, "A,B")]
    assert cross_project.members(rows, "name").count() == 3
    assert cross_project.shared(rows.limit(0), "name").count() == 0


def test_places_within_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.randrange(9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, w int, i int").repartition(7)
    found = {r.i: r.place for r in placed(df, "g", "place", F.desc("w"), F.col("i")).collect()}
    expected = {}
    for g in ("hot", "cold", None):
        expected |= {i: k for k, (_, i) in enumerate(sorted((-w, i) for x, w, i in rows if x == g), 1)}
    assert found == expected


def test_primary_comes_first(spark):
    rows = [("a", 1, 3, 0.9, 5), ("a", 2, 3, 0.95, 1), ("a", 3, 3, None, 0), ("a", 4, 3, None, 7), ("a", 5, 3, None, None), ("b", 6, None, None, 1), ("b", 7, None, 0.1, 0)]
    found = primary_first(spark.createDataFrame(rows, "cluster string, id int, primary int, cosine double, execs int")).orderBy("cluster", "place")
    assert [(r.id, r.place) for r in found.collect()] == [(3, 1), (2, 2), (1, 3), (4, 4), (5, 5), (7, 1), (6, 2)]
