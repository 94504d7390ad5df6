"""Queries of lineage groups, the exact-name matcher, what projects share, places in a group and sliding rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cross_project, lineage, match, ranking
from tessera.plans.catalog import query
from tessera.plans.inputs import PARTS_SQL, named_parts, read
from tessera.streaming import activity


@query("G18_lineage", """WITH g AS (SELECT l_orderkey AS report_id, l_returnflag || l_linestatus AS type, count(*) AS objects, min(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT report_id, type, row_number() OVER (PARTITION BY report_id ORDER BY CASE type WHEN 'RF' THEN 0 WHEN 'NO' THEN 1 ELSE 2 END, type) AS place, CASE objects WHEN 1 THEN name ELSE type || 's (' || objects || ')' END AS label, objects FROM g""")
def source_groups(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("type"))
    return lineage.source_groups(line.join(part, "l_partkey"), ["RF", "NO"])


@query("N2_exact_name", """WITH act AS (SELECT lower(p_name) || ' ' || p_partkey AS n, count(*) AS execs, max(l_shipdate) AS last FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 4 <> 0 GROUP BY 1)
SELECT p_partkey AS report_id, n IS NOT NULL AS matched, coalesce(execs, 0) AS execs, last, (last IS NULL OR last < TIMESTAMP '2003-01-01' - INTERVAL 540 DAY) AS retire FROM part LEFT JOIN act ON n = lower(p_name) || ' ' || p_partkey""")
def exact_name(spark, d):
    part = read(spark, d, "part")
    inventory = part.select(F.col("p_partkey").alias("report_id"), F.concat(F.lit("*"), F.upper("p_name"), F.lit(" "), "p_partkey").alias("name"))
    used = part.where("p_size % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    runs = read(spark, d, "lineitem").select("l_partkey", F.lit(1).cast("long").alias("execs"), F.col("l_shipdate").alias("last"))
    return match.by_name(inventory, runs.join(used, "l_partkey"), "2003-01-01")


@query("STR4_sliding_rollup", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - back * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, range(4) AS r(back) GROUP BY 1, 2")
def sliding_rollup(spark, d):
    return activity.rollup(read(spark, d, "events"), slide="6 hours").withColumn("value", F.round("value", 4))


CROSS_SQL = "string_agg(DISTINCT project, ',' ORDER BY project) AS projects_csv FROM x WHERE {0} <> '' GROUP BY {0} HAVING count(DISTINCT project) > 1"


@query("A18_cross_project_sql", "WITH x AS (SELECT p_brand AS project, CASE WHEN p_size <> 7 THEN sha256('select a from ' || lower(p_type) || ' where b=0') END AS sql_hash FROM part) SELECT sql_hash, count(DISTINCT project) AS projects, count(*) AS reports, " + CROSS_SQL.format("sql_hash"))
def cross_project_sql(spark, d):
    part = read(spark, d, "part")
    statement = F.concat(F.lit("SELECT a  FROM "), "p_type", F.lit(" WHERE b="), "p_size")
    rows = part.select(F.col("p_brand").alias("project"), F.when(F.col("p_size") != 7, F.sha2(text.sql_for_hash(statement), 256)).alias("sql_hash"))
    return cross_project.shared(rows, "sql_hash")


@query("A18_cross_project_tables", "WITH x AS (SELECT p_brand AS project, CASE WHEN p_size % 5 = 0 THEN '' ELSE upper(p_type) END AS table_name FROM part JOIN lineitem ON l_partkey = p_partkey) SELECT table_name, count(DISTINCT project) AS projects, count(*) AS reports, " + CROSS_SQL.format("table_name"))
def cross_project_tables(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("project"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.upper("p_type")).alias("table_name"))
    return cross_project.shared(read(spark, d, "lineitem").select("l_partkey").join(part, "l_partkey"), "table_name")


@query("A18_cross_project_metrics", "WITH x AS (SELECT p_brand AS project, unnest(string_split(p_name, ' ')) AS metric_name FROM part) SELECT metric_name, count(DISTINCT project) AS projects, count(*) AS reports, " + CROSS_SQL.format("metric_name"))
def cross_project_metrics(spark, d):
    return cross_project.shared(read(spark, d, "part").select(F.col("p_brand").alias("project"), F.explode(F.split("p_name", " ")).alias("metric_name")), "metric_name")


@query("A18_cross_project_families", f"WITH {PARTS_SQL}, x AS (SELECT project, regexp_extract(name, '(?s)^(.*) - ', 1) AS family FROM parts WHERE execs > 10) SELECT family, count(DISTINCT project) AS projects, count(*) AS reports, " + CROSS_SQL.format("family"))
def cross_project_families(spark, d):
    return cross_project.shared(named_parts(spark, d).where("execs > 10").withColumn("family", text.family_base(F.col("name"))), "family")


@query("W6_siblings", f"WITH {PARTS_SQL} SELECT report_id, project, row_number() OVER (PARTITION BY project ORDER BY execs DESC, name, report_id) AS place FROM parts")
def siblings(spark, d):
    return ranking.placed(named_parts(spark, d), "project", "place", F.desc("execs"), F.col("name"), F.col("report_id")).select("report_id", "project", "place")


@query("W8_primary_first", """WITH c AS (SELECT p_type AS cluster, max(p_partkey) AS prime FROM part GROUP BY 1), x AS (SELECT p_type AS cluster, p_partkey AS id, prime, CASE WHEN p_size % 3 <> 0 THEN 1 / p_retailprice END AS cosine, p_size AS execs FROM part JOIN c ON cluster = p_type)
SELECT cluster, id, rank() OVER (PARTITION BY cluster ORDER BY id = prime DESC, cosine IS NULL, cosine DESC, execs DESC, id) AS place FROM x""")
def primary_first(spark, d):
    part = read(spark, d, "part")
    prime = part.groupBy(F.col("p_type").alias("cluster")).agg(F.max("p_partkey").alias("primary"))
    rows = part.select(F.col("p_type").alias("cluster"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, 1 / F.col("p_retailprice")).alias("cosine"), F.col("p_size").alias("execs"))
    return ranking.primary_first(rows.join(prime, "cluster")).select("cluster", "id", "place")
