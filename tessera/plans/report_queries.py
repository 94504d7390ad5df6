"""Queries of joins, aggregates, windows, set operations, grids and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import dedup, funnel, usage, views
from tessera.operators.ranking import top_per_group
from tessera.plans.catalog import query
from tessera.plans.grid import GridQuery
from tessera.plans.inputs import features, read
from tessera.streaming import activity


def sales(spark, d):
    line = read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read(spark, d, "nation").select("n_nationkey", "n_name")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


SALES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("P10_view_filter", f"SELECT n_name, c_mktsegment, count(*) AS lines, round(sum(l_quantity), 4) AS quantity FROM {SALES} WHERE l_quantity >= 10 AND l_quantity <= 40 AND c_mktsegment <> 'BUILDING' AND n_name NOT IN ('FRANCE') GROUP BY 1, 2")
def view_filter(spark, d):
    return GridQuery(["n_name", "c_mktsegment"], {"lines": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 4)}, [("l_quantity", "GreaterEqual", 10), ("l_quantity", "LessEqual", 40), ("c_mktsegment", "NotEqual", "BUILDING"), ("n_name", "NotIn", ["FRANCE"])]).run(sales(spark, d))


@query("P12_requested_objects", f"SELECT p_brand, count(*) AS parts, round(avg(p_retailprice), 4) AS price FROM part WHERE (p_size > 3) AND (p_size < 48) AND p_size IN (4, 5, 8, 9, 12, 17, 23, 31, 44) AND p_type LIKE '%O%' AND starts_with(p_brand, 'Brand') AND contains(p_name, 'r') AND p_brand <> 'Brand#55' GROUP BY p_brand ORDER BY parts DESC, price, p_brand LIMIT 15")
def requested_objects(spark, d):
    """The remaining filter operators, a projection of what is asked for, and a sort by three keys."""
    filters = [("p_size", "Greater", 3), ("p_size", "Less", 48), ("p_size", "In", [4, 5, 8, 9, 12, 17, 23, 31, 44]), ("p_type", "Like", "%O%"), ("p_brand", "BeginsWith", "Brand"), ("p_name", "Contains", "r"), ("p_brand", "NotEqual", "Brand#55")]
    wanted = GridQuery(["p_brand"], {"parts": F.count("*"), "price": F.round(F.avg("p_retailprice"), 4)}, filters, sorting=[("parts", False), ("price", True), ("p_brand", True)], limit=15)
    return wanted.run(read(spark, d, "part"))


@query("P11_metric_limits", f"SELECT n_name, count(*) AS lines FROM {SALES} GROUP BY 1 HAVING count(*) > 100")
def metric_limits(spark, d):
    return GridQuery(["n_name"], {"lines": F.count("*")}, metric_limits={"lines": ("Greater", 100)}).run(sales(spark, d))


@query("T5_paging", f"SELECT n_name, o_orderpriority, count(*) AS lines FROM {SALES} GROUP BY 1, 2 ORDER BY lines DESC, n_name, o_orderpriority LIMIT 20 OFFSET 20")
def paging(spark, d):
    return GridQuery(["n_name", "o_orderpriority"], {"lines": F.count("*")}, sorting=[("lines", False), ("n_name", True), ("o_orderpriority", True)], offset=20, limit=20).run(sales(spark, d))


ACTIVITY_SQL = """activity AS (SELECT user_id AS "user", event_type AS object_id, event_type || '/' || (event_id % 7) AS folder, ts AS last, floor(value)::BIGINT AS execs, (event_id % 3)::BIGINT AS sessions, (event_id % 2)::BIGINT AS errors FROM events)"""


def activity_rows(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("user"), F.col("event_type").alias("object_id"), F.concat_ws("/", "event_type", (F.col("event_id") % 7).cast("string")).alias("folder"), F.col("ts").alias("last"), F.floor("value").cast("long").alias("execs"), (F.col("event_id") % 3).alias("sessions"), (F.col("event_id") % 2).alias("errors"))


@query("A1_activity_rollup", f'WITH {ACTIVITY_SQL} SELECT object_id, folder, sum(execs)::BIGINT AS execs, count(DISTINCT "user") AS users, max(last) AS last, sum(sessions)::BIGINT AS sessions, sum(errors)::BIGINT AS errors FROM activity GROUP BY object_id, folder')
def activity_rollup(spark, d):
    return usage.rollup(activity_rows(spark, d), "object_id", "folder")


@query("A2_second_rollup", f'WITH {ACTIVITY_SQL}, r AS (SELECT object_id, folder, sum(execs) AS execs, count(DISTINCT "user") AS users, max(last) AS last, sum(sessions) AS sessions, sum(errors) AS errors FROM activity GROUP BY ALL) SELECT object_id, sum(execs)::BIGINT AS execs, max(users) AS users, max(last) AS last, sum(sessions)::BIGINT AS sessions, sum(errors)::BIGINT AS errors FROM r GROUP BY object_id')
def second_rollup(spark, d):
    return usage.merged_rollup(usage.rollup(activity_rows(spark, d), "object_id", "folder"), "object_id")


@query("A3_latest_record", f'WITH {ACTIVITY_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY last DESC, folder DESC) AS k FROM activity) SELECT a.object_id, a.folder, a.last, b.execs, b.users FROM x a JOIN (SELECT object_id, sum(execs)::BIGINT AS execs, count(DISTINCT "user") AS users FROM activity GROUP BY object_id) b USING (object_id) WHERE k = 1')
def latest_record(spark, d):
    return usage.latest(activity_rows(spark, d).withColumn("user", F.col("user").cast("string")), "object_id", "last", "folder", "last").select("object_id", "folder", "last", "execs", "users")


@query("A21_heavy_users", f"WITH {ACTIVITY_SQL} SELECT \"user\", sum(execs)::BIGINT AS execs, count(DISTINCT object_id) AS objects, sum(sessions)::BIGINT AS sessions, max(last) AS last, \"user\"::VARCHAR LIKE '%7%' AS service FROM activity GROUP BY \"user\" ORDER BY execs DESC, \"user\" LIMIT 100")
def heavy_users(spark, d):
    return usage.heavy_users(activity_rows(spark, d), 100, ["7"])


@query("E16_heavy_user_objects", f"""WITH {ACTIVITY_SQL}, h AS (SELECT "user" FROM activity GROUP BY "user" ORDER BY sum(execs) DESC, "user" LIMIT 100), r AS (SELECT "user", object_id, sum(execs)::BIGINT AS execs, max(last) AS last FROM activity GROUP BY ALL)
SELECT "user", object_id, execs, last, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY execs DESC, object_id) AS rank FROM r WHERE "user" IN (SELECT * FROM h)) WHERE rank <= 25""")
def heavy_user_objects(spark, d):
    rows = activity_rows(spark, d)
    heavy = usage.heavy_users(rows, 100).select("user")
    per = rows.join(heavy, "user", "left_semi").groupBy("user", "object_id").agg(F.sum("execs").alias("execs"), F.max("last").alias("last"))
    return top_per_group(per, ["user"], 25, F.desc("execs"), F.asc("object_id")).withColumn("rank", F.col("rank").cast("long"))


@query("A26_buckets", "SELECT CASE WHEN folder LIKE '/click/%' OR folder LIKE 'click/%' THEN 'one' WHEN folder LIKE '/view/%' OR folder LIKE 'view/%' THEN 'two' ELSE 'other' END AS bucket, count(DISTINCT object_id) AS objects, count(*) AS n FROM (SELECT event_type AS object_id, CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END || event_type || '/x' AS folder FROM events) GROUP BY 1")
def buckets(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("object_id"), F.concat(F.when(F.col("event_id") % 2 == 0, "/").otherwise(""), "event_type", F.lit("/x")).alias("folder"))
    bucket = F.when(usage.prefixed(F.col("folder"), "click"), "one").when(usage.prefixed(F.col("folder"), "view"), "two").otherwise("other")
    return e.groupBy(bucket.alias("bucket")).agg(F.count_distinct("object_id").alias("objects"), F.count("*").alias("n"))


@query("P5_prefix", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END || event_type || '/x' AS folder FROM events) WHERE folder LIKE '/click/%' OR folder LIKE 'click/%'")
def prefix_filter(spark, d):
    folder = F.concat(F.when(F.col("event_id") % 3 == 0, "/").otherwise(""), "event_type", F.lit("/x"))
    return read(spark, d, "events").where(usage.prefixed(folder, "click")).select("event_id")


@query("P6_exclusion", "SELECT event_id FROM events WHERE NOT (lower(event_type) LIKE '%lick%' AND user_id IN (1, 2, 3))")
def exclusion(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("folder"), F.col("user_id").cast("string").alias("user"))
    return usage.without_admin_profiles(rows, ["LICK"], ["1", "2", "3"]).select("event_id")


@query("P8_service_accounts", "SELECT c_custkey, (lower(c_name) LIKE '%svc%' OR c_name LIKE '%#00000000_' OR lower(c_name) LIKE '%11%') AS service FROM customer")
def service_accounts(spark, d):
    return read(spark, d, "customer").select("c_custkey", usage.contains_any(F.col("c_name"), ["svc", "#00000000", "11"]).alias("service"))


def report_table(spark, d):
    """Rows (report_id, name, owner, path, source_type, users, execs) of named parts."""
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("name"), F.concat(F.lit("owner "), F.col("p_size") % 9).alias("owner"), F.concat(F.when(F.col("p_size") % 4 == 0, "/a/Profiles/").otherwise("/Public/"), "p_brand").alias("path"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("source_type"), (F.col("p_size") % 13).cast("long").alias("users"), F.col("p_size").cast("long").alias("execs"))


REPORTS_SQL = "reports AS (SELECT p_partkey AS report_id, p_name AS name, 'owner ' || (p_size % 9) AS owner, CASE WHEN p_size % 4 = 0 THEN '/a/Profiles/' ELSE '/Public/' END || p_brand AS path, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS source_type, (p_size % 13)::BIGINT AS users, p_size::BIGINT AS execs FROM part)"


@query("P13_report_filters", f"WITH {REPORTS_SQL} SELECT report_id, name, execs FROM reports WHERE source_type = '' AND (lower(name) LIKE '%ing%' OR lower(owner) LIKE '%ing%' OR lower(path) LIKE '%ing%') AND lower(path) LIKE '%/public%' AND users > 2 AND execs > 5 ORDER BY execs DESC, report_id LIMIT 5000")
def report_filters(spark, d):
    return views.report_list(report_table(spark, d), source="none", search="ING", place="public", more_users_than=2, more_execs_than=5, sort="execs", most=5000).select("report_id", "name", "execs")


@query("T6_report_sort", f"WITH {REPORTS_SQL} SELECT report_id, name, users FROM reports ORDER BY users DESC, report_id LIMIT 200")
def report_sort(spark, d):
    return views.report_list(report_table(spark, d), sort="users", most=200).select("report_id", "name", "users")


@query("P23_drill_down", f"WITH {REPORTS_SQL} SELECT report_id, source_type FROM reports WHERE execs > 25 AND source_type = 'ECONOMY' AND (lower(name) LIKE '%1%' OR lower(owner) LIKE '%1%' OR lower(path) LIKE '%1%' OR report_id::VARCHAR LIKE '%1%')")
def drill_down(spark, d):
    rows = report_table(spark, d).withColumn("status", F.when(F.col("execs") > 25, "active").otherwise("retired"))
    return views.drill_down(rows, status="active", source="ECONOMY", search="1").select("report_id", "source_type")


@query("J1_active_universe", "SELECT o_custkey AS report_id, first(o_orderkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END, o_orderkey) AS batch_row, c_nationkey AS project, greatest(c_acctbal, 0) AS execs FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND c_acctbal > 0 GROUP BY o_custkey, c_nationkey, c_acctbal")
def active_universe(spark, d):
    inv = read(spark, d, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderstatus").alias("batch"), F.col("o_orderkey").alias("batch_row"))
    tele = read(spark, d, "customer").select(F.col("c_custkey").alias("report_id"), F.col("c_nationkey").alias("project"), F.col("c_acctbal").alias("execs"))
    return funnel.active_universe(inv, tele, {"F": 0, "O": 1}, "batch_row").select("report_id", "batch_row", "project", "execs")


@query("J2_left_telemetry", "SELECT c_custkey AS report_id, c_name AS name, o.n AS execs FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def left_telemetry(spark, d):
    tele = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(F.count("*").alias("execs"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("report_id"), F.col("c_name").alias("name")).join(tele, "report_id", "left")


@query("J3_member_report", "SELECT n.n_name, count(o.o_orderkey) AS orders FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name")
def member_report(spark, d):
    per = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = read(spark, d, "customer").join(per, "c_custkey", "left").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query("J6_collapsed_ids", "SELECT p.p_partkey AS report_id, g.canonical AS canonical_id FROM part p JOIN (SELECT p_name, p_size, min(p_partkey) AS canonical FROM part GROUP BY p_name, p_size) g ON g.p_name = p.p_name AND g.p_size = p.p_size WHERE p.p_partkey <> g.canonical")
def collapsed_ids(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_size").alias("execs"), "p_name", "p_size")
    return dedup.collapsed(dedup.groups_by(rows, [F.col("p_name"), F.col("p_size")])).select("report_id", "canonical_id")


@query("J7_least_source_type", "SELECT s.s_suppkey, x.flag FROM supplier s LEFT JOIN (SELECT l_suppkey, min(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey) x ON x.l_suppkey = s.s_suppkey")
def least_source_type(spark, d):
    least = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_returnflag").alias("flag"))
    return read(spark, d, "supplier").select("s_suppkey").join(least, "s_suppkey", "left")


@query("J8_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def exists(spark, d):
    returned = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("J9_feature_counts", "SELECT o.o_orderkey AS report_id, coalesce(l.a, 0) AS n_part, coalesce(l.b, 0) AS n_supplier FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey")
def feature_counts(spark, d):
    line = read(spark, d, "lineitem")
    features = line.select(F.col("l_orderkey").alias("report_id"), F.inline(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("name")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("name")))))
    return usage.feature_counts(read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id")), features, ["part", "supplier"])


@query("J10_backfill", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN coalesce(s_name, '') ELSE p_name END AS path FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def backfill(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("path"))
    return usage.backfilled(rows, read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path")), "id", "path")


@query("J18_enrichment", "SELECT p_partkey AS id, coalesce(s_name, c_name, 'unknown') AS path FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey")
def enrichment(spark, d):
    sources = [read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path")), read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))]
    return usage.enriched(read(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", "path", sources, "unknown")


@query("J22_family_status", "SELECT p_brand AS family, count(*) AS size, count(*) FILTER (WHERE p_size % 30 > 0) AS active, CASE WHEN count(*) = count(*) FILTER (WHERE p_size % 30 > 0) THEN 'all active' WHEN count(*) FILTER (WHERE p_size % 30 > 0) = 0 THEN 'all retired' ELSE 'partial' END AS status FROM part GROUP BY p_brand")
def family_status(spark, d):
    return usage.family_status(read(spark, d, "part").select(F.col("p_brand").alias("family"), (F.col("p_size") % 30).alias("execs")))


@query("A15_retired_count", "SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def retired_count(spark, d):
    reports = read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("batch"))
    tele = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), (F.col("l_returnflag") != "A").alias("matched"))
    return usage.retired(reports, tele, ["F"]).agg(F.count("*").alias("n"))


TIER = "CASE o_orderpriority WHEN '1-URGENT' THEN 'exact_id' WHEN '2-HIGH' THEN 'exact_name' WHEN '3-MEDIUM' THEN 'full_path' WHEN '5-LOW' THEN 'fuzzy' ELSE 'none' END"


@query("A16_tier_histogram", f"SELECT regexp_extract(t, '^(exact|fuzzy|none)') AS tier, count(*) AS n FROM (SELECT {TIER} AS t FROM orders) WHERE t <> 'full_path' GROUP BY 1")
def tier_histogram(spark, d):
    return usage.tier_histogram(read(spark, d, "orders").select(F.expr(TIER).alias("tier")))


@query("A17_action_histogram", "SELECT coalesce(nullif(CASE l_linestatus WHEN 'O' THEN '' ELSE l_linestatus END, ''), 'UNKNOWN') AS action, count(*) AS n FROM lineitem GROUP BY 1")
def action_histogram(spark, d):
    return usage.action_histogram(read(spark, d, "lineitem").select(F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).otherwise("").alias("action")))


def comparison(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("execs"))
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return usage.quadrants(docs, labels.where("quality = 1"), labels.where("toxic = 1")).join(docs, "id")


COMPARISON_SQL = "comparison AS (SELECT doc_id AS id, n_chars AS execs, CASE WHEN q AND t THEN 'both' WHEN q THEN 'jaccardOnly' WHEN t THEN 'semanticOnly' ELSE 'neither' END AS category FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id) l USING (doc_id))"


@query("A23_quadrants", f"WITH {COMPARISON_SQL} SELECT category, count(*) AS n FROM comparison GROUP BY category")
def quadrant_counts(spark, d):
    return comparison(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("T7_priority_sort", f"WITH {COMPARISON_SQL} SELECT id, category FROM comparison ORDER BY CASE category WHEN 'both' THEN 0 WHEN 'semanticOnly' THEN 1 WHEN 'jaccardOnly' THEN 2 ELSE 3 END, execs DESC, id LIMIT 50")
def priority_sort(spark, d):
    return usage.in_category_order(comparison(spark, d)).limit(50).select("id", "category")


@query("P16_comparison_filter", f"WITH {COMPARISON_SQL} SELECT id FROM comparison WHERE category = 'jaccardOnly' AND id::VARCHAR LIKE '%2%' ORDER BY execs DESC, id LIMIT 2000")
def comparison_filter(spark, d):
    return views.comparison(comparison(spark, d).withColumn("name", F.col("id").cast("string")), "jaccardOnly", "2", ["name"]).select("id")


@query("A25_row_counts", "SELECT 'part' AS name, p_brand AS project, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'line', p_brand, count(*) FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def row_counts(spark, d):
    part = read(spark, d, "part").withColumnRenamed("p_brand", "project")
    line = read(spark, d, "lineitem").select("l_partkey").join(part.select("p_partkey", "project"), F.col("l_partkey") == F.col("p_partkey"))
    return usage.row_counts({"part": part, "line": line}, "project")


@query("A29_unused", "WITH n AS (SELECT p_partkey, lower(p_name || ' ' || p_size) AS name FROM part) SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT name FROM n JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def unused_names(spark, d):
    names = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    line = read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return usage.unused(names, names.join(line, "p_partkey").select(F.upper("name").alias("name")))


@query("A30_frequency", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def frequent(spark, d):
    return usage.frequency(read(spark, d, "lineitem"), "l_partkey", 20)


@query("T1_top_lists", "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 15")
def top_lists(spark, d):
    return usage.frequency(features(spark, d).withColumnRenamed("m", "p_brand"), "p_brand", 15)


@query("A31_shares", "SELECT c_mktsegment, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM customer GROUP BY c_mktsegment")
def shares(spark, d):
    return usage.shares(read(spark, d, "customer"), "c_mktsegment")


@query("A34_status_breakdown", f"WITH {REPORTS_SQL} SELECT source_type, count(*) AS overall, count(*) FILTER (WHERE execs > 0) AS active, count(*) FILTER (WHERE execs > 25) AS final FROM reports GROUP BY source_type")
def status_breakdown(spark, d):
    rows = report_table(spark, d).withColumn("status", F.when(F.col("execs") > 0, "active").otherwise("retired")).withColumn("final", F.col("execs") > 25)
    return views.breakdown(rows)


@query("A38_cost", "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens, greatest(1, length(coalesce(text, '')) // 4)::BIGINT / 1000::DOUBLE * 0.13::DOUBLE AS price FROM documents")
def cost(spark, d):
    return usage.cost(read(spark, d, "documents"), F.col("text"), 0.13).select("doc_id", "tokens", "price")


@query("A41_location_pivot", f"WITH {REPORTS_SQL} SELECT CASE WHEN lower(path) LIKE '%/profiles/%' THEN 'Personal' WHEN lower(path) LIKE '%/public%' THEN 'Public' ELSE 'Other' END AS place, count(*) FILTER (WHERE execs > 20) AS active, count(*) FILTER (WHERE execs <= 20) AS retire, count(*) AS total FROM reports GROUP BY 1")
def location_pivot(spark, d):
    return usage.location_pivot(report_table(spark, d).withColumn("disposition", F.when(F.col("execs") > 20, "retain").otherwise("retire")))


@query("A47_largest_groups", "SELECT min(p_partkey) AS canonical_id, count(*) AS group_size FROM part GROUP BY p_name, p_size HAVING count(*) >= 2 ORDER BY group_size DESC, canonical_id LIMIT 15")
def largest_groups(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.lit(0).alias("execs"), "p_name", "p_size")
    groups = dedup.groups_by(rows, [F.col("p_name"), F.col("p_size")]).where("report_id = canonical_id")
    return groups.orderBy(F.desc("group_size"), "canonical_id").limit(15).select("canonical_id", "group_size")


@query("A50_domain_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label")
def domain_counts(spark, d):
    return usage.frequency(read(spark, d, "embeddings"), "label")


@query("A51_facets", f"WITH {REPORTS_SQL} SELECT 'source_type' AS facet, source_type AS value, count(*) AS n FROM reports GROUP BY 2 UNION ALL SELECT 'owner', owner, count(*) FROM reports GROUP BY 2")
def facets(spark, d):
    return views.facets(report_table(spark, d), ["source_type", "owner"])


@query("T2_top_executed", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_executed(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("W3_ranks", "SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) QUALIFY place <= 15")
def ranks(spark, d):
    top = usage.frequency(read(spark, d, "part"), "p_brand", 15)  # 15 rows, so that one task numbers them
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "p_brand")).cast("long"))


@query("U1_difference", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def difference(spark, d):
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(gone, "id", "left_anti")


@query("U6_final_kept", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def final_kept(spark, d):
    customer = read(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return funnel.final_kept(rows, customer.where("c_acctbal > 0").select("id"), customer.where("c_acctbal > 9000").select("id"), "id")


@query("U7_effective_final", "SELECT c_custkey AS report_id FROM customer WHERE (c_acctbal > 5000 OR c_nationkey = 3) AND c_mktsegment <> 'BUILDING'")
def effective_final(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "report_id")
    return usage.effective_final(c.where("c_acctbal > 5000"), c.where("c_nationkey = 3"), c.where("c_mktsegment = 'BUILDING'"))


@query("U9_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(read(spark, d, "region").select(F.col("r_name").alias("name")))


@query("P21_known_missing", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def known_missing(spark, d):
    docs = read(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("E2_reports", f"WITH {REPORTS_SQL}, g AS (SELECT lower(name) AS k, count(*) AS size, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM reports GROUP BY 1) SELECT r.report_id, r.name, r.execs, g.canonical_id, g.size - 1 AS siblings, r.report_id = g.canonical_id AS is_final_canonical FROM reports r JOIN g ON g.k = lower(r.name)")
def emitted_reports(spark, d):
    rows = report_table(spark, d)
    member = dedup.groups_by(rows, [F.lower("name")], 1).select("report_id", "canonical_id", (F.col("group_size") - 1).alias("siblings"))
    return rows.join(member, "report_id").select("report_id", "name", "execs", "canonical_id", "siblings", (F.col("report_id") == F.col("canonical_id")).alias("is_final_canonical"))


@query("D19_disposition", "SELECT c_custkey AS report_id, CASE WHEN c_nationkey = 3 THEN 'retain' WHEN c_mktsegment = 'BUILDING' THEN 'retire' WHEN c_acctbal > 0 THEN 'retain' ELSE 'retire' END AS disposition, CASE WHEN c_nationkey = 3 OR c_mktsegment = 'BUILDING' THEN 'user' ELSE 'funnel' END AS decided_by FROM customer")
def disposition(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "report_id")
    reports = c.select("report_id", (F.col("c_acctbal") > 0).alias("kept"))
    return usage.disposition(reports, c.where("c_nationkey = 3"), c.where("c_mktsegment = 'BUILDING'")).select("report_id", "disposition", "decided_by")


@query("D20_toggle", "SELECT c_custkey AS report_id, 'retained' AS list FROM customer WHERE c_nationkey IN (3, 4) UNION ALL SELECT c_custkey, 'retired' FROM customer WHERE c_nationkey = 5")
def toggle(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("report_id"), "c_nationkey")
    kept, gone = usage.toggle(c.where("c_nationkey = 3").select("report_id"), c.where("c_nationkey IN (4, 5)").select("report_id"), c.where("c_nationkey IN (3, 4)"), True)
    return kept.withColumn("list", F.lit("retained")).unionByName(gone.withColumn("list", F.lit("retired")))


@query("G11_domains", "SELECT label AS domain, count(*) AS size, avg(c) AS confidence, min(c) AS least, first(vec_id ORDER BY c DESC, vec_id) AS primary_id FROM (SELECT vec_id, label, (vec_id % 10) / 10.0::DOUBLE AS c FROM embeddings) GROUP BY label HAVING count(*) >= 2")
def domains(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("report_id"), F.col("label").alias("domain"), ((F.col("vec_id") % 10) / F.lit(10.0)).alias("confidence"))
    return views.domains(rows).where("size >= 2")


@query("STR1_daily_rollup", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def daily_rollup(spark, d):
    return activity.rollup(read(spark, d, "events")).withColumn("value", F.round("value", 4))


@query("STR2_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    return activity.sessions(read(spark, d, "events"))
