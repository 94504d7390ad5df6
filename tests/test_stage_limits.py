"""A run up to a stage, and components of two kinds of links."""

from tessera.llm import simhash
from tessera.plans import pipeline_queries


def test_a_run_stops_at_its_last_stage(spark):
    d = "/root/testdata/sf0.001"
    assert set(pipeline_queries.run(spark, d, last="universe").kept) == {"universe"}
    part, whole = pipeline_queries.run(spark, d, last="family"), pipeline_queries.run(spark, d)
    assert "similarity" not in part.members
    assert sorted(map(tuple, part.members["family"].collect())) == sorted(map(tuple, whole.members["family"].collect()))


def test_links_of_both_kinds_connect(spark):
    schema = "doc_id long, component_id long"
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (None, 4), (5, 5)], schema)
    other = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4), (None, None), (5, 5)], schema)
    found = [(r.doc_id, r.component_id) for r in simhash.united(one, other).collect()]
    assert sorted(found, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (5, 5)], key=str)
