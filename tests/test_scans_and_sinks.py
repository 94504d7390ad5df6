"""Bounded JSON scans, paged sources and the merging stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import inventory, json_items, pages
from tessera.streaming import activity, upsert

SF = "/root/testdata/sf0.001"


@pytest.fixture
def split_size(spark):
    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def records(seed, n):
    r = random.Random(seed)
    names = ["plain", "a } b", '{ [ "quoted\\" } ', "end\\", "tab\t}", "né}日", '",{"x":"', "}{", "line\nbreak }"]
    return [{"id": f"r{i}", "name": r.choice(names), "n": [{"k": [1, {"z": "}"}]}, {}][: r.randint(0, 2)], "e": {}} for i in range(n)]


DUMPS = [json.dumps, lambda x: json.dumps(x, indent=2), lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))]


@pytest.mark.parametrize("dump", DUMPS)
@pytest.mark.parametrize("size", [61, 500, 1 << 20])
def test_array_scan_does_not_depend_on_splits(spark, split_size, tmp_path, dump, size):
    rows = records(size, 50)
    (tmp_path / "a.json").write_text(dump(rows))
    split_size(size)
    found = json_items.items(spark, str(tmp_path / "a.json"))
    assert [json.loads(x.value) for x in found.orderBy("split", "item").collect()] == rows
    parts = json_items.pieces(spark, str(tmp_path / "a.json"), "}").select("split").distinct().count()
    assert parts > 3 or size > 500


def test_array_scan_edges(spark, split_size, tmp_path):
    for i, (text, wanted) in enumerate([("", []), ("[]", []), (" [ ] \n", []), ('[{"a":1}][{"a":2},{"a":3}]', [1, 2, 3]), ('[\n{"a":1}\n]\n[ {"a":2} ]\n', [1, 2]), ('[{"b":"' + "x}" * 3000 + '","a":5},{"a":6}]', [5, 6])]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        for size in (50, 1 << 20):
            split_size(size)
            assert sorted(x.a for x in json_items.read_json_array(spark, str(path), "a int").collect()) == wanted
    all_files = json_items.read_json_array(spark, str(tmp_path), "a int")
    assert sorted(x.a for x in all_files.collect()) == [1, 1, 2, 2, 3, 5, 6]


def test_lists_scan(spark, split_size, tmp_path):
    lists = {f"k{i}" + "x" * (i % 40): [f"h]{j}" for j in range(i % 4)] for i in range(40)}
    for size in (70, 1 << 20):
        split_size(size)
        (tmp_path / "m.json").write_text(json.dumps(lists, indent=size % 3))
        assert {x.key: x["values"] for x in json_items.read_json_lists(spark, str(tmp_path / "m.json")).collect()} == lists
    found = inventory.read_ast_cache(spark, str(tmp_path / "m.json"))
    assert {(r.key, r.hash, r.kind) for r in found.collect()} == {(k, h, "report" if len(k) >= 30 else "ast_cluster") for k, v in lists.items() for h in v}


def test_inventory_as_one_array(spark, split_size, tmp_path):
    rows = [{"id": f"i{k}" if k % 7 else None, "name": "N }", "metrics": [{"id": "1", "name": "M"}], "sourceTables": ["t{"]} for k in range(30)]
    (tmp_path / "inv.json").write_text(json.dumps(rows))
    split_size(90)
    found = inventory.read_inventory(spark, str(tmp_path / "inv.json"), lines=False)
    assert {r.id for r in found.collect()} == {x["id"] for x in rows if x["id"]}
    assert {tuple(r) for r in inventory.shred(found, "metrics").collect()} == {(x["id"], "M") for x in rows if x["id"]}


@pytest.mark.parametrize("n", [0, 1, 7, 10, 30, 31, 47])
@pytest.mark.parametrize("stripes", [1, 3])
def test_pages_end_at_a_short_one(spark, n, stripes):
    def fetch(offset, limit):
        rows = [{"id": f"d{i}", "name": "é"} for i in range(offset, min(n, offset + limit))]
        page = offset // limit
        return json.dumps([rows, {"result": rows, "total": n}, {"results": rows}, {"items": rows}, {"result": None, "objects": rows}][page % 5])

    found = pages.read_pages(spark, f"paged_{n}_{stripes}", fetch, limit=10, stripes=stripes)
    rows = found.orderBy("place").collect()
    assert [(r.place, json.loads(r.value)) for r in rows] == [(i, {"id": f"d{i}", "name": "é"}) for i in range(n)]


def test_answers_without_rows():
    assert [pages.rows_of(x) for x in ('{"error": 1}', "null", '{"items": {}}', "7")] == [[], [], [], []]


def test_merging_stream_equals_batch_and_replays(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "value")
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    keys, path = ["start", "event_type"], str(tmp_path / "table")
    schema = "start timestamp, event_type string, n bigint, value double"
    seen = []

    def prepare(batch):
        seen.append(batch.count())
        return activity.rollup(batch)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    upsert.merge_stream(stream, path, keys, upsert.totals(keys), str(tmp_path / "c"), prepare, buckets=8).awaitTermination()
    rounded = ["start", "event_type", "n", F.round("value", 4).alias("value")]
    wanted = {tuple(r) for r in activity.rollup(events).select(*rounded).collect()}

    def found(before=None):
        return {tuple(r) for r in upsert.current(spark, path, schema, before).select(*rounded).collect()}

    assert len(seen) == 3 and sum(seen) == events.count() and found() == wanted and found(1) != wanted
    # the last batch is run again: what it holds is known from the table before it
    again = activity.rollup(events.limit(10))
    upsert.merge_batch(again, 3, path, keys, upsert.totals(keys), 8)
    once = found()
    upsert.merge_batch(again, 3, path, keys, upsert.totals(keys), 8)
    assert found() == once != wanted and found(3) == wanted


def test_last_row_of_a_key_wins(spark, tmp_path):
    keys, path, schema = ["id"], str(tmp_path / "t"), "id int, at int, name string"
    batches = [[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "d"), (3, 1, None)], [(2, 0, "old")]]
    assert upsert.current(spark, path, schema).count() == 0
    for number, rows in enumerate(batches):
        for _ in range(2):
            upsert.merge_batch(spark.createDataFrame(rows, schema), number, path, keys, upsert.last_wins(keys, "at"), 4)
    assert {tuple(r) for r in upsert.current(spark, path, schema).collect()} == {(1, 3, "c"), (2, 1, "b"), (3, 1, None)}
    upsert.merge_batch(spark.createDataFrame([], schema), 9, path, keys, upsert.last_wins(keys, "at"), 4)
    assert upsert.current(spark, path, schema).count() == 3


def test_once_drops_events_seen_before(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    stream = activity.once(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "3650 days")
    run = stream.writeStream.outputMode("append").format("memory").queryName("seen_once").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("seen_once").count() == events.select("event_id").distinct().count()
