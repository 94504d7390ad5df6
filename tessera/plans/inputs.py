"""How the star-schema tables play the parts of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def features(spark, d: str) -> DataFrame:
    """Rows (report_id, m, t, f): an order's brands, types and line states."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("f"))
    part = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("m"), F.col("p_type").alias("t"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("report_id"), "m", "t", "f")


def reports(spark, d: str) -> DataFrame:
    """Rows (report_id, execs): orders with their truncated price as executions."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.floor("o_totalprice").cast("long").alias("execs"))


def named_parts(spark, d: str) -> DataFrame:
    """Rows (report_id, name, project, execs, path): parts as named reports of several projects."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.concat("p_type", F.lit(" family - "), "p_name").alias("name"), F.col("p_brand").alias("project"), F.col("p_size").cast("long").alias("execs"), F.concat(F.lit("/Public/"), "p_brand").alias("path"))


#: The same as common table expressions.
SETS_SQL = """feat AS (SELECT l_orderkey AS report_id, lower(p_brand) AS m, lower(p_type) AS t, lower(l_returnflag || l_linestatus) AS f
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sets AS (SELECT report_id, list_sort(list_distinct(list(m))) AS m, list_sort(list_distinct(list(t))) AS t, list_sort(list_distinct(list(f))) AS f FROM feat GROUP BY report_id),
reports AS (SELECT o_orderkey AS report_id, floor(o_totalprice)::BIGINT AS execs FROM orders)"""
PARTS_SQL = """parts AS (SELECT p_partkey AS report_id, p_type || ' family - ' || p_name AS name, p_brand AS project, p_size::BIGINT AS execs, '/Public/' || p_brand AS path FROM part)"""
