"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

from tessera.sources import inventory
from tessera.streaming import activity

SF = "/root/testdata/sf0.001"


def test_inventory_and_children(spark, tmp_path):
    path = tmp_path / "inventory.json"
    path.write_text("\n".join(json.dumps(x) for x in [{"id": "a", "name": "A", "metrics": [{"id": "1", "name": "M"}, {"id": "2", "name": "N"}]}, {"name": "no id"}, {"id": "b", "metrics": []}]))
    records = inventory.read_inventory(spark, str(path))
    assert {r.id for r in records.collect()} == {"a", "b"}
    assert {tuple(r) for r in inventory.shred(records, "metrics").collect()} == {("a", "M"), ("a", "N")}


def test_activity_counts(spark, tmp_path):
    path = tmp_path / "activity.csv"
    path.write_text('Report Name,Object ID,Folder Path,User,Action,Executions,Sessions,Errors,Last Execution\nA,o1,/p,u,run,"1,234",,x,2024-01-01 00:00:00\n')
    row = inventory.read_activity(spark, str(path)).first()
    assert (row.executions, row.sessions, row.errors) == (1234, 0, 0)


def test_positional(spark, tmp_path):
    path = tmp_path / "positional.csv"
    path.write_text(",".join("abcdefghijkl") + '\nN,/p,u,t,p,"1,000",,,,,,1/2/2024 3:04\nshort,row\nM,/p,u,t,p,bad,,,,,,never\n')
    rows = {r.name: r for r in inventory.read_positional(spark, str(path)).collect()}
    assert rows["N"].executions == 1000 and rows["N"].last.year == 2024 and rows["M"].executions == 0 and rows["M"].last is None and "short" not in rows


def test_ast_cache(spark, tmp_path):
    path = tmp_path / "ast.json"
    path.write_text(json.dumps({"r" * 32: ["h1", "h2"], "c1": ["h3"]}))
    assert {(r.hash, r.kind) for r in inventory.read_ast_cache(spark, str(path)).collect()} == {("h1", "report"), ("h2", "report"), ("h3", "ast_cluster")}


def test_upsert_and_project_replace(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    assert {tuple(r) for r in inventory.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    path = str(tmp_path / "t")
    for rows in ([("p", 1), ("q", 2)], [("q", 3)]):
        inventory.replace_project(spark.createDataFrame(rows, "project_id string, x int"), path)
    assert {(r.project_id, r.x) for r in spark.read.parquet(path).collect()} == {("p", 1), ("q", 3)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = activity.rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    columns = [F.col("start").cast("timestamp").alias("start"), "event_type", "n", F.round("value", 4).alias("value")]
    assert set(spark.table("rolled").select(*columns).collect()) == set(activity.rollup(events).select(*columns).collect())
