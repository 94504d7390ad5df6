"""Queries of the combined project and of the small tables that sum a run up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import combined, funnel, summaries
from tessera.plans.catalog import query
from tessera.plans.inputs import read
from tessera.plans.pipeline_queries import RUN_SQL, inputs, run
from tessera.storage import materialize, shared_dir

TAG = "('p' || ({0} % 3) || ':' || {0})"
COMBINED_SQL = RUN_SQL
for _old, _new in (
    ("inv AS (SELECT c_custkey AS report_id, c_custkey % 4 AS batch,", f"inv AS (SELECT {TAG.format('c_custkey')} AS report_id, 0 AS batch,"),
    ("AS name FROM customer),", "AS name FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 5 <> 0 AND floor(c_acctbal)::BIGINT % 40 <> 0),"),
    ("tele AS (SELECT c_custkey AS report_id,", f"tele AS (SELECT {TAG.format('c_custkey')} AS report_id,"),
    ("fsets AS (SELECT o_custkey AS report_id,", f"fsets AS (SELECT {TAG.format('o_custkey')} AS report_id,"),
    ("hset AS (SELECT o_custkey AS report_id,", f"hset AS (SELECT {TAG.format('o_custkey')} AS report_id,"),
    ("\nhashes AS (SELECT c_custkey AS report_id,", f"\nhashes AS (SELECT {TAG.format('c_custkey')} AS report_id,"),
):
    assert _old in COMBINED_SQL
    COMBINED_SQL = COMBINED_SQL.replace(_old, _new)


def build(spark, d):
    """Three projects' kept reports, combined twice: the third keeps more at the second time, and it alone is copied again."""
    inventory, features, telemetry, statements, hashes = inputs(spark, d)
    project = F.concat(F.lit("p"), F.col("report_id") % 3)
    kept = funnel.active_universe(inventory, telemetry, funnel.BATCHES, "name").where("report_id % 5 <> 0").select(project.alias("project"), "report_id")
    kept = materialize(kept, "kept")  # every table of both builds is joined to it
    tables = {n: t.withColumn("project", project) for n, t in (("inventory", inventory), ("features", features), ("telemetry", telemetry), ("statements", statements), ("hashes", hashes))}
    both = combined.Combined(spark, f"{shared_dir(spark)}/tessera/combined-{uuid.uuid4().hex}")
    both.rebuild(kept.where("project <> 'p2' OR report_id % 7 <> 0"), tables, "2024-01-01")
    both.rebuild(kept, tables, "2024-02-01")
    return both


@query("D14_combined_reports", f"WITH RECURSIVE {COMBINED_SQL} SELECT report_id, 'p' || string_split(report_id, ':')[1][2:] AS source, string_split(report_id, ':')[2] AS source_id, s AS survivor_id, stage FROM s6")
def combined_reports(spark, d):
    both = build(spark, d)
    return both.with_source(both.run().survivors()).select("report_id", "source", "source_id", "survivor_id", "stage")


@query("D14_combined_funnel", f"WITH RECURSIVE {COMBINED_SQL} SELECT ordinal, stage, remaining FROM counts")
def combined_funnel(spark, d):
    return build(spark, d).run().counts()


@query("D14_build_log", "WITH k AS (SELECT 'p' || (c_custkey % 3) AS source, count(*) AS reports FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 5 <> 0 AND floor(c_acctbal)::BIGINT % 40 <> 0 GROUP BY 1) SELECT source, reports, CASE WHEN source = 'p2' THEN '2024-02-01' ELSE '2024-01-01' END AS built_at FROM k")
def build_log(spark, d):
    return build(spark, d).log().select("source", "reports", "built_at")


@query("D3_canonical_path", "WITH g AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN NULL ELSE '/' || p_name END AS path FROM part), c AS (SELECT p_brand, first(p_partkey ORDER BY p_size DESC, p_partkey) AS c FROM part GROUP BY p_brand) SELECT g.p_brand AS group_id, coalesce(max(path) FILTER (WHERE p_partkey = c AND path <> ''), first(path ORDER BY p_partkey) FILTER (WHERE path <> ''), '') AS path FROM g JOIN c USING (p_brand) GROUP BY g.p_brand")
def canonical_paths(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_size").alias("execs"), F.col("p_brand").alias("group_id"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 2, F.concat(F.lit("/"), "p_name")).alias("path"))
    best = p.groupBy("group_id").agg(funnel.canonical("report_id", "execs").alias("canonical_id"))
    return summaries.canonical_paths(p.join(best, "group_id"))


@query("J4_collision_features", f"WITH RECURSIVE {RUN_SQL} SELECT report_id, canonical_id, coalesce(array_to_string(m, ','), '') AS metrics, coalesce(array_to_string(t, ','), '') AS tables FROM collision LEFT JOIN fsets USING (report_id)")
def collision_features(spark, d):
    _, features, *_ = inputs(spark, d)
    rows = summaries.with_features(run(spark, d).members["collision"], metrics=features.select("report_id", F.lower("m").alias("name")), tables=features.select("report_id", F.lower("t").alias("name")))
    return rows.select("report_id", "canonical_id", F.array_join("metrics", ",").alias("metrics"), F.array_join("tables", ",").alias("tables"))


@query("D22_backfill", "SELECT p_partkey AS report_id, 'metric' AS kind, CASE WHEN p_size % 2 = 0 THEN 'n1' ELSE 'o' END AS id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS name FROM part UNION ALL SELECT p_partkey, 'metric', 'n2', p_name FROM part WHERE p_size % 2 = 0")
def backfill(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "report_id")
    item = lambda i, n: F.struct(F.lit(i).alias("id"), n.alias("name"))
    items = F.array(item("n1", F.col("p_type")), item("n2", F.col("p_name")), item("n3", F.col("p_type")), item("n4", F.lit("")))
    old = p.select("report_id", F.lit("metric").alias("kind"), F.lit("o").alias("id"), F.col("p_brand").alias("name"))
    return summaries.replaced_features(old, p.where("p_size % 2 = 0").select("report_id", F.lit("metric").alias("kind"), items.alias("items")))


@query("A27_families", """WITH r AS (SELECT p_partkey AS id, p_type || ' variants - ' || p_size AS name, p_retailprice AS execs, p_brand AS place, p_type || ' variants' AS base FROM part), b AS (SELECT base, count(*) AS n, first(id ORDER BY execs DESC, id) AS id FROM r GROUP BY base)
SELECT count(*) FILTER (WHERE n >= 2) AS families, coalesce(sum(n) FILTER (WHERE n >= 2), 0)::BIGINT AS members, coalesce(sum(n - 1) FILTER (WHERE n >= 2), 0)::BIGINT AS reducible, count(*) AS consolidated, (SELECT string_agg(place || '=' || k, ',' ORDER BY place) FROM (SELECT place, count(*) AS k FROM b JOIN r ON r.id = b.id GROUP BY place)) AS by_place FROM b""")
def report_families(spark, d):
    p = read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("report_id"), F.concat("p_type", F.lit(" variants - "), "p_size").alias("name"), F.col("p_retailprice").alias("execs"), F.col("p_brand").alias("place"))
    pairs = F.array_join(F.transform(F.map_entries("by_place"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return summaries.families(rows).select("families", "members", "reducible", "consolidated", pairs.alias("by_place"))


@query("A32_structural_removal", f"WITH RECURSIVE {RUN_SQL}, q AS (SELECT (SELECT count(*) - count(DISTINCT canonical_id) FROM sql_hash) AS by_statement, (SELECT count(*) - count(DISTINCT canonical_id) FROM ast) AS by_shape) SELECT by_statement, by_shape, greatest(by_statement, by_shape) AS removed FROM q")
def structural_removal(spark, d):
    found = run(spark, d).members
    sized = {n: found[n].groupBy("canonical_id").agg(F.count("*").alias("size")) for n in ("sql_hash", "ast")}
    return summaries.structural_removal(sized["sql_hash"], sized["ast"])


@query("A33_orphan_categories", "SELECT CASE WHEN p_size % 5 = 0 THEN '?' ELSE p_type END AS category, count(*) AS n FROM part GROUP BY 1")
def orphan_categories(spark, d):
    return summaries.histogram(read(spark, d, "part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("category")), "category")


@query("A36_totals", "WITH g AS (SELECT p_brand, count(*) AS size FROM part GROUP BY p_brand) SELECT (SELECT sum(size - 1)::BIGINT FROM g) AS reducible, (SELECT sum(size)::BIGINT FROM g) AS reports, sum(c_custkey) FILTER (WHERE c_nationkey <> 3)::BIGINT AS human_execs, sum(c_custkey) FILTER (WHERE c_nationkey = 3)::BIGINT AS service_execs, count(*) FILTER (WHERE c_nationkey = 3) AS services FROM customer")
def totals(spark, d):
    groups = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("size"))
    return summaries.totals(groups, read(spark, d, "customer").select(F.col("c_custkey").alias("execs"), (F.col("c_nationkey") == 3).alias("service")))


@query("A36_cluster_statements", "SELECT p_brand AS cluster_id, count(*) FILTER (WHERE p_size % 3 = 0) AS n, sum(p_size)::BIGINT AS execs FROM part GROUP BY p_brand")
def cluster_statements(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_brand").alias("cluster_id"), F.col("p_size").cast("long").alias("execs"))
    return summaries.statements_per_cluster(p, p.select("report_id", F.when(F.col("execs") % 3 == 0, "select 1").otherwise("").alias("sql")))


@query("E9_ast_hashes", "SELECT o_custkey AS report_id, array_to_string(list_sort(list_distinct(list(o_orderpriority || '/' || o_orderstatus))), ',') AS hashes FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey")
def ast_hashes(spark, d):
    """Handed out as one JSON object for each task and read again as an AST cache is."""
    from tessera.sources.json_items import read_json_lists

    found = inputs(spark, d)[4]
    path = f"{shared_dir(spark)}/tessera/ast-hashes-{uuid.uuid4().hex}"
    entry = F.map_from_arrays(F.array(F.col("report_id").cast("string")), F.array("hashes"))
    found.select(F.to_json(entry).alias("value")).write.text(path)
    return read_json_lists(spark, path).select(F.col("key").cast("long").alias("report_id"), F.array_join(F.array_sort("values"), ",").alias("hashes"))


@query("E11_singletons", f"WITH RECURSIVE {RUN_SQL}, alone AS (SELECT * FROM k4 WHERE report_id NOT IN (SELECT report_id FROM similarity)) SELECT 'SINGLETONS' AS cluster_id, count(*) AS size, coalesce(sum(execs), 0)::BIGINT AS execs, first(name ORDER BY execs DESC, report_id) AS example FROM alone HAVING count(*) > 0")
def singletons(spark, d):
    result = run(spark, d)
    rows = result.kept["family"].select("report_id", "name", "execs", F.lit(0).alias("users"))
    return summaries.singletons(rows, result.members["similarity"]).select("cluster_id", "size", "execs", "example")


@query("T9_singleton_list", "SELECT p_partkey AS report_id FROM part WHERE p_size % 3 <> 0 ORDER BY p_partkey LIMIT 500")
def singleton_list(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "report_id")
    return summaries.singleton_list(p, p.where("p_size % 3 = 0"))


@query("T10_parent_reports", "WITH c AS (SELECT p_partkey AS id, p_partkey - p_size % 4 AS parent FROM part WHERE p_size % 4 > 0) SELECT p_partkey AS report_id, p_name AS name, count(c.id) + 1 AS copies, count(c.id) AS children, count(c.id) + 1 AS size FROM part LEFT JOIN c ON parent = p_partkey WHERE p_partkey NOT IN (SELECT id FROM c) GROUP BY 1, 2")
def parent_reports(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("name"), "p_size")
    return summaries.parent_reports(p, p.select("report_id", (F.col("report_id") - F.col("p_size") % 4).alias("parent_id")))


@query("S20_report_stubs", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_size AS type, p_brand AS owner FROM part")
def report_stubs(spark, d):
    p = read(spark, d, "part")
    plain, nested = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("type"), F.col("p_brand").alias("owner")), F.struct(F.col("p_partkey").cast("string").alias("objectId"), F.col("p_name").alias("name"), F.col("p_size").alias("type"), F.struct(F.col("p_brand").alias("name"), F.lit("x").alias("id")).alias("owner"))
    return summaries.stubs(p.select(F.when(F.col("p_size") % 2 == 0, F.to_json(plain)).otherwise(F.to_json(nested)).alias("value"))).select("id", "name", "type", "owner")


@query("E18_experiment_rows", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, min(vec_id) AS primary_id FROM v WHERE label % 3 > 0 GROUP BY label),
m AS (SELECT v.label, c.primary_id, v.vec_id, CASE WHEN v.vec_id = c.primary_id THEN 1.0 ELSE round(list_cosine_similarity(v.v, p.v), 4) END AS away FROM v JOIN c USING (label) JOIN v p ON p.vec_id = c.primary_id)
SELECT 'XC' || label AS id, count(*) AS size, any_value(primary_id) AS primary_id, 'n' || any_value(primary_id) AS primary_name, sum(vec_id % 50)::BIGINT AS execs, round(min(away), 3) AS least_cosine, false AS singletons FROM m GROUP BY label
UNION ALL SELECT 'XSING', count(*), min(vec_id), 'n' || min(vec_id), sum(vec_id % 50)::BIGINT, NULL, true FROM v WHERE label % 3 = 0 HAVING count(*) > 0""")
def experiment_rows(spark, d):
    e = read(spark, d, "embeddings")
    in_cluster = e.where("label % 3 > 0").select(F.concat(F.lit("XC"), "label").alias("id"), F.col("vec_id").alias("report_id"), F.col("embedding").alias("vector"))
    everyone = e.select(F.col("vec_id").alias("report_id"), F.concat(F.lit("n"), "vec_id").alias("name"), (F.col("vec_id") % 50).alias("execs"), F.lit(0).alias("users"))
    rows = summaries.experiment_rows(in_cluster.groupBy("id").agg(F.min("report_id").alias("primary_id")), in_cluster, everyone)
    return rows.select("id", "size", "primary_id", "primary_name", "execs", F.round("least_cosine", 3).alias("least_cosine"), "singletons")
