"""Queries of what comes in and goes out: scans, streams, reviews, trees, comparisons and emitted files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.text import family_base
from tessera.operators import comparison, embedding_sets, hierarchy, reviews, similarity
from tessera.plans import condense, cross_emit
from tessera.plans.catalog import query
from tessera.plans.graph_queries import PAIRS_SQL, forests, links
from tessera.plans.inputs import PARTS_SQL, named_parts, read
from tessera.sources import inventory, json_items
from tessera.storage import materialize, shared_dir
from tessera.streaming import activity, upsert


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def as_arrays(rows, key, per: int):
    """JSON arrays of up to ``per`` rows each, as texts; ``key`` is a number that runs through the rows."""
    record = F.struct(*rows.columns)
    return rows.groupBy(F.floor(F.col(key) / per)).agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value")).select("value")


@query("S1_json_array_scan", "SELECT o_orderkey AS key, 'a } \"' || o_orderstatus || '\" [{ \\' AS note, o_orderpriority AS inner_name FROM orders")
def json_array_scan(spark, d):
    note = F.concat(F.lit('a } "'), "o_orderstatus", F.lit('" [{ \\'))
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), note.alias("note"), F.array(F.struct(F.col("o_orderpriority").alias("n"))).alias("inner"))
    path = fresh(spark, "arrays")
    as_arrays(rows, "key", 500).write.text(path)
    found = json_items.read_json_array(spark, path, "key long, note string, inner array<struct<n: string>>")
    return found.select("key", "note", F.col("inner")[0]["n"].alias("inner_name"))


RECORDS = 'CASE p_size % 3 WHEN 0 THEN \'"DB"."T_\' || p_size || \'"\' ELSE \'x.t\' || p_size END'


@query("S3_field_extraction", f"""WITH r AS (SELECT p_partkey AS id, p_brand AS m, p_type AS a, {RECORDS} AS t, p_size AS s FROM part)
SELECT id AS report_id, 'metric' AS kind, 'm' || s AS field_id, m AS name FROM r UNION ALL SELECT id, 'table', '', list_last(string_split(lower(trim(t, '"')), '.')) FROM r
UNION ALL SELECT id, 'attribute', 'b', a FROM r UNION ALL SELECT id, 'filter', '', lower(a) FROM r WHERE s % 2 = 0 UNION ALL SELECT id, 'filter', '', 'deep ' || s FROM r WHERE s % 2 = 0""")
def field_extraction(spark, d):
    p = read(spark, d, "part")
    named = lambda i, n: F.struct(i.alias("id"), n.alias("name"))
    tree = F.to_json(F.struct(F.col("p_type").alias("name"), F.array(F.struct(F.struct(F.concat(F.lit("Deep "), "p_size").alias("name")).alias("form"))).alias("nodes")))
    table = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"DB"."T_'), "p_size", F.lit('"'))).otherwise(F.concat(F.lit("x.t"), "p_size"))
    records = p.select(
        F.col("p_partkey").alias("id"), F.array(named(F.concat(F.lit("m"), "p_size"), F.col("p_brand")), named(F.lit("z"), F.lit(""))).alias("metrics"), F.array(named(F.lit("a"), F.col("p_type")), named(F.lit("b"), F.col("p_type"))).alias("attributes"),
        F.array(table).alias("sourceTables"), F.struct(F.when(F.col("p_size") % 2 == 0, tree).otherwise("[]").alias("tree"), F.lit("").alias("text")).alias("filter"),
    )
    return inventory.fields_of(records).select("report_id", "kind", F.coalesce("id", F.lit("")).alias("field_id"), "name")


@query("STR5_merged_rollup", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def merged_rollup(spark, d):
    path, keys = fresh(spark, "merged"), ["start", "event_type"]
    known = read(spark, d, "events").schema
    stream = spark.readStream.schema(known).parquet(f"{d}/event[s].parquet")  # a pattern, so that one file will do as well as a folder
    upsert.merge_stream(stream, path, keys, upsert.totals(keys), f"{path}-checkpoint", activity.rollup).awaitTermination()
    found = upsert.current(spark, path, "start timestamp, event_type string, n bigint, value double")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


ACTIONS = "CASE p_size % 4 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'RETIRE' WHEN 2 THEN '' ELSE 'ERROR' END"
# brands that end with 1 have canonical reviews of their even parts, and these count instead of the nested ones of all parts
REVIEWS_SQL = f"""r AS (SELECT p_brand AS project, 'C' || p_partkey AS cluster_id, p_name AS label, {ACTIONS} AS action, CASE WHEN p_size % 5 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS removable
  FROM part WHERE p_brand NOT LIKE '%1' OR p_size % 2 = 0)"""


def review_documents(spark, d):
    size = F.col("p_size")
    action = F.when(size % 4 == 0, "MERGE").when(size % 4 == 1, "RETIRE").when(size % 4 == 2, "").otherwise("ERROR")
    removable = F.when(size % 7 != 0, size)  # else missing
    p = read(spark, d, "part").select("p_brand", size.alias("size"), F.col("p_partkey").alias("number"), F.col("p_name").alias("label"), action.alias("action"), F.when(size % 5 == 0, "high").otherwise("low").alias("confidence"), removable.alias("removable_count"))
    canonical = p.where(F.endswith("p_brand", F.lit("1")) & (F.col("size") % 2 == 0))
    canonical = canonical.select("p_brand", "size", F.struct(F.concat(F.lit("C"), "number").alias("clusterId"), "label", F.col("action").alias("consolidation_action"), "confidence", "removable_count").alias("r"))
    canonical = canonical.groupBy("p_brand", "size").agg(F.to_json(F.collect_list("r")).alias("value"))
    nested = p.select("p_brand", "size", F.struct(F.col("number").alias("clusterId"), F.struct("label", "action", "confidence", "removable_count").alias("analysis")).alias("r"))
    nested = nested.groupBy("p_brand", "size").agg(F.to_json(F.struct(F.collect_list("r").alias("reviews"))).alias("value"))
    return canonical.unionByName(nested).select(F.col("p_brand").alias("project"), "value")


@query("D12_review_import", f"WITH {REVIEWS_SQL} SELECT project, cluster_id, label, action AS consolidation_action, confidence, removable AS removable_count FROM r")
def review_import(spark, d):
    return reviews.imported(review_documents(spark, d)).select("project", "cluster_id", "label", "consolidation_action", "confidence", "removable_count")


@query("D12_action_counts", f"WITH {REVIEWS_SQL} SELECT project, CASE WHEN action = '' THEN 'UNKNOWN' ELSE action END AS action, count(*) AS n FROM r GROUP BY 1, 2")
def action_counts(spark, d):
    return reviews.action_counts(review_documents(spark, d))


@query("E13_llm_reviews", f"WITH {REVIEWS_SQL} SELECT project, cluster_id AS clusterId, label, action AS consolidation_action, '' AS keep_report, removable AS removable_count FROM r")
def emitted_reviews(spark, d):
    """Handed out as JSON lists and read again."""
    out = reviews.emitted(reviews.imported(review_documents(spark, d)))
    again = out.groupBy("project", F.col("removable_count").alias("n")).agg(F.to_json(F.collect_list(F.struct(*[c for c in out.columns if c != "project"]))).alias("value"))
    return reviews.imported(again).select("project", F.col("cluster_id").alias("clusterId"), "label", "consolidation_action", "keep_report", "removable_count")


@query("A35_review_summary", f"WITH {REVIEWS_SQL}, a AS (SELECT CASE WHEN action = '' THEN 'UNKNOWN' ELSE action END AS action, count(*) AS n FROM r GROUP BY 1) SELECT count(*) AS reviewed, sum(removable)::BIGINT AS removable, count(*) FILTER (WHERE confidence = 'high' AND removable > 0) AS safe, (SELECT string_agg(action || '=' || n, ',' ORDER BY action) FROM a) AS by_action FROM r")
def review_summary(spark, d):
    row = reviews.summary(reviews.imported(review_documents(spark, d)))
    return row.select("reviewed", "removable", "safe", F.array_join(F.transform(F.map_entries("by_action"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_action"))


@query("A46_opportunities", f"WITH {REVIEWS_SQL} SELECT cluster_id, action AS consolidation_action, removable AS removable_count FROM r WHERE action <> 'ERROR' AND removable > 0 ORDER BY removable DESC, cluster_id LIMIT 12")
def opportunities(spark, d):
    return reviews.opportunities(reviews.imported(review_documents(spark, d))).select("cluster_id", "consolidation_action", "removable_count")


@query("S11_similarity_shapes", "SELECT p_partkey::VARCHAR AS a, (p_partkey + 1)::VARCHAR AS b, p_size / 50.0::DOUBLE AS combined, CASE WHEN p_size % 2 = 0 THEN p_size / 100.0::DOUBLE END AS metric FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) AND p_partkey + 1 IN (SELECT s_suppkey FROM supplier)")
def similarity_shapes(spark, d):
    """Pairs of which every second is written as an entry of an object, the others as objects of a list; ends that are no supplier go."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("a"), (F.col("p_partkey") + 1).cast("string").alias("b"), (F.col("p_size") / 50).alias("score"), (F.col("p_size") / 100).alias("metric"), (F.col("p_size") % 2 == 0).alias("entry"))
    path = fresh(spark, "pairs")
    entry = F.map_from_entries(F.collect_list(F.struct(F.concat("a", F.lit("|"), "b"), F.struct(F.col("score").alias("combined"), "metric"))))
    objects = p.where("entry").groupBy(F.substring("a", 1, 1)).agg(F.to_json(entry).alias("value")).select("value")
    lists = p.where("NOT entry").groupBy(F.substring("a", 1, 1)).agg(F.to_json(F.collect_list(F.struct("a", "b", "score"))).alias("value")).select("value")
    objects.unionByName(lists).write.text(path)
    known = read(spark, d, "supplier").select(F.col("s_suppkey").alias("report_id"))
    return reviews.similarity_pairs(json_items.items(spark, path), known).select("a", "b", "combined", "metric")


TREE_SQL = """rel AS (SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT n_name, n_name || ' ' || c_mktsegment FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION SELECT n_name || ' ' || c_mktsegment, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT c_name, c_name || ' ' || o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey
  UNION SELECT n_name || ' ' || c_mktsegment, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey)"""


def tree_relations(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.concat_ws(" ", "n_name", "c_mktsegment")
    o = c.join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = [n.select("r_name", "n_name"), c.select("n_name", segment), c.select(segment, "c_name"), o.select("c_name", F.concat_ws(" ", "c_name", "o_orderstatus")), c.select(segment, "n_name")]  # the last lead back
    out = pairs[0].toDF("parent", "child")
    for p in pairs[1:]:
        out = out.unionByName(p.toDF("parent", "child"))
    return out


@query("G17_hierarchy_tree", f"WITH RECURSIVE {TREE_SQL}, ways AS (SELECT DISTINCT parent AS node, NULL::VARCHAR AS parent, 0 AS depth, [parent] AS path FROM rel WHERE parent NOT IN (SELECT child FROM rel) UNION ALL SELECT r.child, w.node, w.depth + 1, list_append(w.path, r.child) FROM ways w JOIN rel r ON r.parent = w.node WHERE NOT list_contains(w.path, r.child)) SELECT node, parent, depth, array_to_string(path, '/') AS path FROM ways")
def hierarchy_tree(spark, d):
    return hierarchy.trees(tree_relations(spark, d)).select("node", "parent", "depth", F.array_join("path", "/").alias("path"))


@query("G2_forest_extras", f"""WITH RECURSIVE {PAIRS_SQL}, ranked AS (SELECT a, b, cosine, row_number() OVER (ORDER BY cosine DESC, a, b) AS k FROM hits),
reach(k, node, seen) AS (SELECT k, a, a FROM ranked UNION SELECT r.k, r.node, CASE WHEN e.a = r.seen THEN e.b ELSE e.a END FROM reach r JOIN ranked e ON e.k < r.k AND (e.a = r.seen OR e.b = r.seen)),
marked AS (SELECT *, EXISTS (SELECT 1 FROM reach r WHERE r.k = h.k AND r.seen = h.b) AS extra FROM ranked h),
placed AS (SELECT *, row_number() OVER (PARTITION BY extra ORDER BY k) AS place FROM marked)
SELECT a, b, extra, round(cosine, 6) AS cosine FROM placed WHERE NOT extra OR place <= (SELECT count(*) // 50 FROM marked)""")
def forest_extras(spark, d):
    """The forest, and extra edges up to a fiftieth of all edges."""
    edges = materialize(links(spark, d).withColumnRenamed("cosine", "w"), "links")
    forest = materialize(similarity.spanning_forest(forests(spark, d).withColumnRenamed("cosine", "w")), "forest")
    out = similarity.forest_and_extras(edges, forest.count() + edges.count() // 50, forest)
    return out.select("a", "b", "extra", F.round("w", 6).alias("cosine"))


CLUSTERINGS_SQL = "j AS (SELECT p_partkey AS report_id, p_type AS c FROM part WHERE p_size % 3 > 0), s AS (SELECT p_partkey AS report_id, p_brand AS c FROM part WHERE p_size % 5 > 0), js AS (SELECT c, count(*) AS n FROM j GROUP BY c), ss AS (SELECT c, count(*) AS n FROM s GROUP BY c)"


def clusterings(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "report_id")
    return p, p.where("p_size % 3 > 0").select("report_id", F.col("p_type").alias("cluster_id")), p.where("p_size % 5 > 0").select("report_id", F.col("p_brand").alias("cluster_id"))


@query("E15_cluster_comparison", f"WITH {CLUSTERINGS_SQL} SELECT p_partkey AS report_id, j.c AS jaccard_cluster, js.n AS jaccard_size, s.c AS semantic_cluster, ss.n AS semantic_size, CASE WHEN j.c IS NOT NULL AND s.c IS NOT NULL THEN 'both' WHEN s.c IS NOT NULL THEN 'semanticOnly' WHEN j.c IS NOT NULL THEN 'jaccardOnly' ELSE 'neither' END AS category FROM part LEFT JOIN j ON j.report_id = p_partkey LEFT JOIN js ON js.c = j.c LEFT JOIN s ON s.report_id = p_partkey LEFT JOIN ss ON ss.c = s.c")
def cluster_comparison(spark, d):
    p, first, second = clusterings(spark, d)
    rows = comparison.side_by_side(p.select("report_id", F.col("p_size").alias("execs")), first, second)
    return comparison.in_order(rows).select("report_id", "jaccard_cluster", "jaccard_size", "semantic_cluster", "semantic_size", "category")


@query("E15_partners", f"""WITH {CLUSTERINGS_SQL}, cells AS (SELECT j.c AS a, s.c AS b, count(*) AS shared FROM j JOIN s USING (report_id) GROUP BY 1, 2), x AS (SELECT a, b, shared::DOUBLE / (js.n + ss.n - shared) AS w FROM cells JOIN js ON js.c = a JOIN ss ON ss.c = b),
pa AS (SELECT a, b, w FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1), pb AS (SELECT a, b, w FROM x QUALIFY row_number() OVER (PARTITION BY b ORDER BY w DESC, a) = 1)
SELECT 'jaccard' AS side, a AS cluster_id, b AS partner, round(w, 6) AS jaccard, (a, b) IN (SELECT (a, b) FROM pb) AS mutual FROM pa UNION ALL SELECT 'semantic', b, a, round(w, 6), (a, b) IN (SELECT (a, b) FROM pa) FROM pb""")
def cluster_partners(spark, d):
    _, first, second = clusterings(spark, d)
    return comparison.partners(comparison.overlaps(first, second)).select("side", "cluster_id", "partner", F.round("jaccard", 6).alias("jaccard"), "mutual")


@query("A24_semantic_counts", f"WITH {CLUSTERINGS_SQL}, n AS (SELECT count(DISTINCT c) AS clusters, count(DISTINCT report_id) AS members FROM s) SELECT clusters, members, greatest(0, (SELECT count(*) FROM part) - members) AS singletons, clusters + greatest(0, (SELECT count(*) FROM part) - members) AS final FROM n")
def semantic_counts(spark, d):
    p, _, second = clusterings(spark, d)
    return comparison.final_counts(second, p)


@query("G14_embedding_sets", "SELECT 'set ' || source AS name, source AS project, count(*) AS report_count, greatest(1, sum(length(text)) // 4)::BIGINT AS token_estimate, 2 AS version, count(DISTINCT text) AS texts FROM documents WHERE source IN ('src1', 'src2') AND coalesce(text, '') <> '' GROUP BY source")
def saved_sets(spark, d):
    """Two sets of documents, each saved and then refreshed, beside a third that is deleted again."""
    docs = read(spark, d, "documents").select("source", F.col("doc_id").alias("report_id"), "text")
    sets = embedding_sets.EmbeddingSets(spark, fresh(spark, "embedding-sets"))
    for source in ("src1", "src2"):
        for now in ("2024-01-01", "2024-02-01"):
            sets.save({"name": f"set {source}", "project": source, "dimensions": 16}, docs.where(F.col("source") == source), now)
    sets.save({"name": "third"}, docs.where("source = 'src3'"), "2024-03-01")
    sets.delete("third")
    members = [sets.members(f"set {s}").agg(F.countDistinct("content_hash").alias("texts")).select(F.lit(f"set {s}").alias("name"), "texts") for s in ("src1", "src2")]
    return sets.list().join(members[0].unionByName(members[1]), "name").select("name", "project", "report_count", "token_estimate", "version", "texts")


CROSS_SQL = f"{PARTS_SQL}, k AS (SELECT lower(name) AS key, project, report_id FROM parts), g AS (SELECT key, count(DISTINCT project) AS projects, count(*) AS reports FROM k GROUP BY key HAVING count(DISTINCT project) >= 2)"


def cross_tables(spark, d):
    parts = named_parts(spark, d)
    p = read(spark, d, "part").select(F.col("p_brand").alias("project"), "p_type", "p_size", F.col("p_partkey").alias("report_id"))
    names = parts.select(F.lower("name").alias("key"), "project", "report_id", "name", "path", F.col("execs").alias("executions"))
    return cross_emit.tables(names, p.select(F.md5(F.concat("p_type", "p_size").cast("binary")).alias("key"), "project", "report_id"), p.select(F.col("p_type").alias("key"), "project"), p.select(F.col("p_size").cast("string").alias("key"), "project"), parts.select(F.lower(family_base(F.col("name"))).alias("key"), "project"), parts.select("project").distinct())


@query("E17_name_matches", f"WITH {CROSS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY projects DESC, reports DESC, key) AS n FROM g) SELECT 'NM' || lpad(n::VARCHAR, 5, '0') AS id, n.key AS name, projects AS n_projects, reports AS n_reports, project AS member_project, report_id AS member_id FROM n JOIN k USING (key)")
def name_matches(spark, d):
    """The emitted file, read again with a row for each member."""
    folder = fresh(spark, "cross")
    cross_emit.write({"name_matches": cross_tables(spark, d)["name_matches"]}, folder)
    back = spark.read.json(f"{folder}/name_matches")
    return back.select("id", F.col("normalizedName").alias("name"), F.col("nProjects").alias("n_projects"), F.col("nReports").alias("n_reports"), F.explode("members").alias("m")).select("id", "name", "n_projects", "n_reports", F.col("m.projectId").alias("member_project"), F.col("m.reportId").alias("member_id"))


@query("E17_shared_tables", "WITH k AS (SELECT p_type AS key, p_brand AS project FROM part) SELECT key AS name, count(DISTINCT project) AS n_projects, count(*) AS n_references, array_to_string(list_sort(list_distinct(list(project))), ',') AS projects FROM k GROUP BY key HAVING count(DISTINCT project) >= 2")
def shared_tables(spark, d):
    return cross_tables(spark, d)["shared_tables"].select(F.col("tableName").alias("name"), F.col("nProjects").alias("n_projects"), F.col("nReferences").alias("n_references"), F.array_join("projects", ",").alias("projects"))


def shared_count(key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT 1 FROM part GROUP BY {key} HAVING count(DISTINCT p_brand) >= 2))"


@query("E17_summary", f"""WITH {CROSS_SQL} SELECT (SELECT count(*) FROM g) AS name_matches, {shared_count("md5(p_type || p_size)")} AS sql_matches, {shared_count("p_type")} AS shared_tables, {shared_count("p_size")} AS shared_metrics,
{shared_count("lower(CASE WHEN length(p_type || ' family') >= 10 THEN p_type || ' family' ELSE p_type || ' family - ' || p_name END)")} AS shared_families, (SELECT string_agg(DISTINCT project, ',' ORDER BY project) FROM parts) AS projects""")
def cross_summary(spark, d):
    s = cross_tables(spark, d)["summary"]
    return s.select(F.col("nameMatches").alias("name_matches"), F.col("sqlMatches").alias("sql_matches"), F.col("sharedTables").alias("shared_tables"), F.col("sharedMetrics").alias("shared_metrics"), F.col("sharedFamilies").alias("shared_families"), F.array_join("projects", ",").alias("projects"))


CONTEXT_SQL = """r AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS src, CASE WHEN p_size % 3 = 0 THEN 'retired' ELSE 'active' END AS status, p_size % 2 = 0 AS final, p_size AS w FROM part),
c AS (SELECT p_type AS id, count(*) AS size FROM part GROUP BY p_type), s AS (SELECT p_brand AS id, count(*) AS size FROM part GROUP BY p_brand), f AS (SELECT p_size AS id, count(*) AS size FROM part GROUP BY p_size)"""


@query("E19_context", f"""WITH {CONTEXT_SQL}, src AS (SELECT CASE WHEN src = '' THEN 'unknown' ELSE src END AS src, count(*) FILTER (WHERE final) AS n FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM r WHERE final) AS final_kept, (SELECT string_agg(src || '=' || n, ',' ORDER BY src) FROM src WHERE n > 0) AS final_sources, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM r GROUP BY 1)) AS statuses,
(SELECT count(*) FROM c) AS clusters, (SELECT count(*) FROM s) AS semantic, (SELECT count(*) FROM f) AS families,
(SELECT string_agg(id, ',' ORDER BY w DESC, id) FROM (SELECT * FROM r WHERE final ORDER BY w DESC, id LIMIT 50)) AS top_reports, (SELECT string_agg(id, ',' ORDER BY size DESC, id) FROM (SELECT * FROM c ORDER BY size DESC, id LIMIT 20)) AS top_clusters, (SELECT string_agg(id, ',' ORDER BY size DESC, id) FROM (SELECT * FROM f ORDER BY size DESC, id LIMIT 15)) AS top_families""")
def context(spark, d):
    p = read(spark, d, "part")
    reports = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("source_type"), F.when(F.col("p_size") % 3 == 0, "retired").otherwise("active").alias("status"), (F.col("p_size") % 2 == 0).alias("final"), F.col("p_size").alias("weight"))
    clusters, semantic, families = (p.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("weight")).select("id", F.col("id").cast("string").alias("name"), "weight", (F.col("weight") - 1).alias("reducible")) for c in ("p_type", "p_brand", "p_size"))
    row = condense.condensed(reports, clusters, semantic, families)
    ids = lambda c, kind: F.array_join(F.transform(F.from_json(c, f"array<struct<id: {kind}>>"), lambda x: x["id"]), ",")
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return row.select(F.col("finalKeptCount").alias("final_kept"), pairs("finalKept").alias("final_sources"), pairs("statusBreakdown").alias("statuses"), F.col("jaccardClusterCount").alias("clusters"), F.col("semanticClusterCount").alias("semantic"), F.col("familyCount").alias("families"), ids("finalKeptTop", "string").alias("top_reports"), ids("jaccardTopClusters", "string").alias("top_clusters"), ids("familyTop", "string").alias("top_families"))


@query("M1_json_names", "SELECT n_nationkey AS id, 1 AS depth, '$' AS path, n_name AS name FROM nation UNION ALL SELECT n_nationkey, 3, '$.parts[0]', r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_nationkey, 4, '$.parts[1].deep', lower(n_name) FROM nation")
def json_names(spark, d):
    from tessera.functions.json_tree import names_in

    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = F.struct(F.col("n_name").alias("name"), F.array(F.struct(F.col("r_name").alias("name"), F.lit(None).cast("struct<name: string>").alias("deep")), F.struct(F.lit(None).cast("string").alias("name"), F.struct(F.lower("n_name").alias("name")).alias("deep"))).alias("parts"))
    return names_in(n.select(F.col("n_nationkey").alias("id"), F.to_json(tree).alias("tree")), "id", "tree")
