"""Queries of the deduplication funnel, its groups and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import family_base, sql_for_hash, variant_suffix
from tessera.operators import cross_project, dedup, match
from tessera.operators.ranking import canonical, numbered, top_per_group
from tessera.plans.catalog import query
from tessera.plans.inputs import PARTS_SQL, SETS_SQL, features, named_parts, read, reports

FINGERPRINT_SQL = f"""{SETS_SQL},
grp AS (SELECT m, t, f, count(*) AS group_size, sum(execs)::BIGINT AS total_execs, first(report_id ORDER BY execs DESC, report_id) AS canonical_id
  FROM sets JOIN reports USING (report_id) WHERE len(m) + len(t) + len(f) >= 3 GROUP BY m, t, f HAVING count(*) >= 2),
member AS (SELECT s.report_id, g.group_size, g.canonical_id, g.total_execs FROM sets s JOIN grp g ON s.m = g.m AND s.t = g.t AND s.f = g.f)"""
HASH_SQL = f"""{PARTS_SQL},
hashed AS (SELECT report_id, execs, substr(sha256(trim(regexp_replace('select a from ' || lower(substr(name, 1, 24)) || ' join ZTMP on b = 0 ', '\\s+', ' ', 'g'))), 1, 16) AS h FROM parts),
hgrp AS (SELECT h, count(*) AS group_size, sum(execs)::BIGINT AS total_execs, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM hashed GROUP BY h HAVING count(*) >= 2)"""
FAMILY_SQL = f"""{PARTS_SQL},
based AS (SELECT *, regexp_extract(name, '(?s)^(.*) - ', 1) AS base FROM parts),
fam AS (SELECT base, count(*) AS size, sum(execs)::BIGINT AS total_execs, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM based GROUP BY base HAVING count(*) >= 2)"""


def sets(spark, d):
    return dedup.feature_sets(features(spark, d)).join(reports(spark, d), "report_id")


def hashed(spark, d):
    sql = F.concat(F.lit("SET query_group='r"), "report_id", F.lit("'; SELECT a FROM "), F.substring("name", 1, 24), F.lit(" JOIN ZZT"), "report_id", F.lit(" ON b = "), "execs", F.lit(" -- "), "report_id")
    return named_parts(spark, d).withColumn("h", F.substring(F.sha2(sql_for_hash(sql), 256), 1, 16))


def families(spark, d):
    rows = named_parts(spark, d).withColumn("base", family_base(F.col("name")))
    grp = rows.groupBy("base").agg(F.count("*").alias("size"), F.sum("execs").alias("total_execs"), canonical("report_id", "execs").alias("canonical_id")).where("size >= 2")
    return rows, grp


@query("D5_fingerprint", f"WITH {FINGERPRINT_SQL} SELECT * FROM member")
def fingerprint(spark, d):
    return dedup.fingerprint(sets(spark, d)).drop("group_key")


@query("A7_group_stats", f"WITH {FINGERPRINT_SQL} SELECT canonical_id, group_size, group_size - 1 AS reducible, total_execs FROM grp")
def group_stats(spark, d):
    members = dedup.fingerprint(sets(spark, d))
    return members.where("report_id = canonical_id").select("canonical_id", "group_size", (F.col("group_size") - 1).alias("reducible"), "total_execs")


@query("W2_group_ids", f"WITH {FINGERPRINT_SQL} SELECT printf('FP%04d', row_number() OVER (ORDER BY group_size DESC, canonical_id)) AS group_id, canonical_id, group_size FROM grp")
def group_ids(spark, d):
    groups = dedup.fingerprint(sets(spark, d)).where("report_id = canonical_id")
    out = numbered(groups, "n", F.desc("group_size"), F.asc("canonical_id"))
    return out.select(F.format_string("FP%04d", "n").alias("group_id"), "canonical_id", "group_size")


@query("P9_quality_gate", f"WITH {SETS_SQL} SELECT report_id, len(m) + len(t) + len(f) AS signal FROM sets WHERE len(m) + len(t) + len(f) >= 3")
def quality_gate(spark, d):
    n = F.size("m") + F.size("t") + F.size("f")
    return dedup.feature_sets(features(spark, d)).select("report_id", n.cast("long").alias("signal")).where(F.col("signal") >= 3)


@query("U2_after_fingerprint", f"WITH {FINGERPRINT_SQL} SELECT report_id, execs FROM sets JOIN reports USING (report_id) WHERE report_id NOT IN (SELECT report_id FROM member WHERE report_id <> canonical_id)")
def after_fingerprint(spark, d):
    rows = sets(spark, d)
    return dedup.survivors(rows, dedup.fingerprint(rows)).select("report_id", "execs")


@query("D6_hash_groups", f"WITH {HASH_SQL} SELECT report_id, h, group_size, canonical_id, total_execs FROM hashed JOIN hgrp USING (h)")
def hash_groups(spark, d):
    rows = hashed(spark, d)
    grp = rows.groupBy("h").agg(F.count("*").alias("group_size"), F.sum("execs").alias("total_execs"), canonical("report_id", "execs").alias("canonical_id")).where("group_size >= 2")
    return rows.join(grp, "h").select("report_id", "h", "group_size", "canonical_id", "total_execs")


@query("A9_sequential_removable", f"WITH {HASH_SQL} SELECT coalesce(sum(group_size - 1), 0)::BIGINT AS removable, count(*) AS groups FROM hgrp")
def sequential_removable(spark, d):
    grp = hashed(spark, d).groupBy("h").count().where(F.col("count") >= 2)
    return grp.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removable"), F.count("*").alias("groups"))


@query("D8_family", f"WITH {FAMILY_SQL} SELECT b.report_id, b.base, f.size, f.canonical_id, f.total_execs, ltrim(substr(b.name, len(b.base) + 1), ' -') AS suffix FROM based b JOIN fam f USING (base)")
def family(spark, d):
    rows, grp = families(spark, d)
    return rows.join(grp, "base").select("report_id", "base", "size", "canonical_id", "total_execs", variant_suffix(F.col("name"), F.col("base")).alias("suffix"))


@query("A42_largest_families", f"WITH {FAMILY_SQL}, m AS (SELECT base, count(*) AS size, count(*) FILTER (WHERE execs > 25) AS active, count(*) FILTER (WHERE execs <= 25) AS retired FROM based GROUP BY base HAVING count(*) >= 2) SELECT * FROM m ORDER BY size DESC, base LIMIT 20")
def largest_families(spark, d):
    rows, _ = families(spark, d)
    grp = rows.groupBy("base").agg(F.count("*").alias("size"), F.count_if(F.col("execs") > 25).alias("active"), F.count_if(F.col("execs") <= 25).alias("retired")).where("size >= 2")
    return grp.orderBy(F.desc("size"), "base").limit(20)


@query("A43_partly_active_families", f"WITH {FAMILY_SQL}, m AS (SELECT base, count(*) AS size, count(*) FILTER (WHERE execs > 25) AS active FROM based GROUP BY base) SELECT base, size, active, 100.0::DOUBLE * active / size AS percent FROM m WHERE active > 0 AND active < size ORDER BY size DESC, base LIMIT 15")
def partly_active(spark, d):
    rows, _ = families(spark, d)
    grp = rows.groupBy("base").agg(F.count("*").alias("size"), F.count_if(F.col("execs") > 25).alias("active")).where("active > 0 AND active < size")
    return grp.select("base", "size", "active", (F.lit(100.0) * F.col("active") / F.col("size")).alias("percent")).orderBy(F.desc("size"), "base").limit(15)


@query("A44_family_totals", f"WITH {FAMILY_SQL}, m AS (SELECT base, count(*) AS size, count(*) FILTER (WHERE execs > 25) AS active FROM based GROUP BY base) SELECT count(*) FILTER (WHERE active = size) AS all_active, count(*) FILTER (WHERE active = 0) AS all_retired, count(*) FILTER (WHERE active > 0 AND active < size) AS partial, avg(size) AS mean_size FROM m")
def family_totals(spark, d):
    rows, _ = families(spark, d)
    m = rows.groupBy("base").agg(F.count("*").alias("size"), F.count_if(F.col("execs") > 25).alias("active"))
    return m.agg(F.count_if(F.expr("active = size")).alias("all_active"), F.count_if(F.expr("active = 0")).alias("all_retired"), F.count_if(F.expr("active > 0 AND active < size")).alias("partial"), F.avg("size").alias("mean_size"))


COLLISION_SQL = """src AS (SELECT p_partkey AS report_id, p_name AS name, (p_size - 1)::BIGINT AS execs, p_brand AS last, 'exact_id' AS tier, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS norm FROM part),
g1 AS (SELECT execs, last, first(report_id ORDER BY len(norm), report_id) AS c1 FROM src WHERE execs > 0 GROUP BY execs, last HAVING count(*) >= 2 AND count(DISTINCT norm) = 1),
m1 AS (SELECT src.*, g1.c1 FROM src LEFT JOIN g1 ON src.execs = g1.execs AND src.last = g1.last AND src.execs > 0),
g2 AS (SELECT norm, execs AS e2, min(report_id) AS c2 FROM m1 WHERE execs > 0 AND (c1 IS NULL OR c1 = report_id) GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("D2_collisions", f"WITH {COLLISION_SQL} SELECT report_id, CASE WHEN c1 IS NOT NULL AND c1 <> report_id THEN c1 WHEN c2 IS NOT NULL THEN c2 ELSE report_id END AS canonical_id, CASE WHEN c1 IS NOT NULL AND c1 <> report_id THEN 1 WHEN c2 IS NOT NULL AND c2 <> report_id THEN 2 ELSE 0 END AS pass FROM m1 LEFT JOIN g2 ON m1.norm = g2.norm AND m1.execs = g2.e2")
def collisions(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("name"), (F.col("p_size") - 1).cast("long").alias("execs"), F.col("p_brand").alias("last"), F.lit("exact_id").alias("tier"))
    return dedup.collisions(rows)


@query("N1_waterfall", """WITH inv AS (SELECT p_partkey AS report_id, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS name, p_brand AS path FROM part),
act AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 10000000 END AS object_id, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS path, p_size::BIGINT AS execs FROM part),
t0 AS (SELECT report_id, 'exact_id' AS tier, execs, object_id FROM inv JOIN act ON report_id = object_id),
t1 AS (SELECT a.report_id, 'full_path' AS tier, b.execs, b.object_id FROM
  (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY report_id) AS turn FROM inv WHERE report_id NOT IN (SELECT report_id FROM t0)) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY execs DESC, object_id) AS turn FROM act WHERE object_id NOT IN (SELECT object_id FROM t0)) b USING (name, path, turn)),
d1 AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1),
t2 AS (SELECT a.report_id, 'exact_name' AS tier, b.execs, b.object_id FROM
  (SELECT *, row_number() OVER (PARTITION BY name ORDER BY report_id) AS turn FROM inv WHERE name <> '' AND report_id NOT IN (SELECT report_id FROM d1)) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY name ORDER BY execs DESC, object_id) AS turn FROM act WHERE object_id NOT IN (SELECT object_id FROM d1)) b USING (name, turn)),
d2 AS (SELECT * FROM d1 UNION ALL SELECT * FROM t2)
SELECT report_id, tier, execs FROM d2 UNION ALL SELECT report_id, 'none', 0 FROM inv WHERE report_id NOT IN (SELECT report_id FROM d2)""")
def waterfall(spark, d):
    part = read(spark, d, "part")
    name = F.when(F.col("p_size") == 7, "").otherwise(F.col("p_name"))
    inv = part.select(F.col("p_partkey").alias("report_id"), F.concat(name, F.lit("* ")).alias("name"), F.concat(F.lit("/"), "p_brand").alias("path"))
    act = part.select((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(10000000)).alias("object_id"), name.alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("path"), F.col("p_size").cast("long").alias("execs"))
    return match.waterfall(inv, act)


@query("A18_cross_project_names", f"WITH {PARTS_SQL} SELECT lower(name) AS name, count(DISTINCT project) AS projects, count(*) AS reports, string_agg(DISTINCT project, ',' ORDER BY project) AS projects_csv FROM parts GROUP BY lower(name) HAVING count(DISTINCT project) >= 2")
def cross_project_names(spark, d):
    return cross_project.shared(named_parts(spark, d).withColumn("name", F.lower("name")), "name")


@query("J19_cross_project_members", f"WITH {PARTS_SQL}, g AS (SELECT lower(name) AS n FROM parts GROUP BY 1 HAVING count(DISTINCT project) >= 2) SELECT report_id, project, lower(name) AS name, execs FROM parts WHERE lower(name) IN (SELECT n FROM g)")
def cross_project_members(spark, d):
    return cross_project.members(named_parts(spark, d).withColumn("name", F.lower("name")), "name").select("report_id", "project", "name", "execs")


@query("D15_drift", f"WITH {PARTS_SQL} SELECT project, 'n=' || count(*) || ';' || sum(('0x' || substr(md5(report_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM parts GROUP BY project")
def drift(spark, d):
    return dedup.drift(named_parts(spark, d), "project")


@query("A12_common_features", f"WITH {FINGERPRINT_SQL}, x AS (SELECT canonical_id, group_size, m.report_id, unnest(s.t) AS feature FROM member m JOIN sets s ON s.report_id = m.report_id) SELECT canonical_id, feature, count(DISTINCT report_id) AS n FROM x GROUP BY canonical_id, group_size, feature HAVING count(DISTINCT report_id) = group_size")
def common_features(spark, d):
    rows = sets(spark, d)
    x = dedup.fingerprint(rows).join(rows.select("report_id", F.explode("t").alias("feature")), "report_id")
    return x.groupBy("canonical_id", "group_size", "feature").agg(F.count("*").alias("n")).where("n = group_size").drop("group_size")


@query("A22_data_quality", f"WITH {SETS_SQL}, q AS (SELECT o_orderpriority AS cluster, CASE WHEN m IS NULL THEN 0 ELSE len(m) + len(t) + len(f) END AS n FROM orders LEFT JOIN sets ON report_id = o_orderkey), a AS (SELECT cluster, avg((n = 0)::INT) AS e, avg((n < 3)::INT) AS l, count(*) AS members FROM q GROUP BY cluster) SELECT cluster, members, CASE WHEN e >= 0.8 THEN 'low' WHEN l >= 0.8 THEN 'low' WHEN e >= 0.5 THEN 'mixed' ELSE 'high' END AS quality FROM a")
def data_quality(spark, d):
    s = dedup.feature_sets(features(spark, d)).select("report_id", (F.size("m") + F.size("t") + F.size("f")).alias("n"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("cluster"))
    n = F.coalesce("n", F.lit(0))
    a = o.join(s, "report_id", "left").groupBy("cluster").agg(F.avg((n == 0).cast("int")).alias("e"), F.avg((n < 3).cast("int")).alias("l"), F.count("*").alias("members"))
    return a.select("cluster", "members", F.when(F.col("e") >= 0.8, "low").when(F.col("l") >= 0.8, "low").when(F.col("e") >= 0.5, "mixed").otherwise("high").alias("quality"))


@query("W4_top_per_user", "SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 25")
def top_per_user(spark, d):
    return top_per_group(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], 25, F.desc("value"), F.asc("event_id")).withColumn("rank", F.col("rank").cast("long"))


@query("W1_first_per_report", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY o_custkey")
def first_per_report(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.count("*").alias("n"))
