"""Readers and writers of inventories, activity logs and caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.json_tree import names_in
from tessera.functions.text import norm_table
from tessera.sources.json_items import read_json_array, read_json_lists

NAMED = "array<struct<id: string, name: string>>"
RECORD = f"id string, name string, owner string, folderPath string, sourceType string, prompted boolean, sql string, metrics {NAMED}, attributes {NAMED}, sourceTables array<string>, filter struct<tree: string, text: string>"
ACTIVITY = ["name", "object_id", "folder", "user", "action", "executions", "sessions", "errors", "last_execution"]


def read_inventory(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Records with an id, from JSON lines or from one JSON array in a file; either is split among tasks."""
    records = spark.read.schema(RECORD).json(path) if lines else read_json_array(spark, path, RECORD)
    return records.where(F.coalesce("id", F.lit("")) != "")


def shred(records: DataFrame, column: str) -> DataFrame:
    """Child rows (report_id, name) of an array of named structs, each name once in a record's order."""
    return records.select(F.col("id").alias("report_id"), F.explode(column).alias("x")).select("report_id", "x.name")


def fields_of(records: DataFrame) -> DataFrame:
    """``report_id``, ``kind`` (metric, table, filter or attribute), ``id``, ``name``: all child rows of records with the columns of RECORD.

    Metrics as they are, table names normalised, attributes with the last id of a
    name, and the names anywhere in the filter's tree in small letters; each row
    once.  Empty names, and trees that are no objects, give no row.
    """
    named = F.coalesce("name", F.lit("")) != ""
    none = F.lit(None).cast("string")
    metrics = records.select(F.col("id").alias("report_id"), F.inline("metrics")).select("report_id", F.lit("metric").alias("kind"), "id", "name").where(named)
    tables = records.select(F.col("id").alias("report_id"), F.explode("sourceTables").alias("t")).select("report_id", F.lit("table").alias("kind"), none.alias("id"), norm_table(F.col("t")).alias("name")).where(named)
    attributes = records.select(F.col("id").alias("report_id"), F.posexplode("attributes").alias("place", "x")).groupBy("report_id", F.col("x.name").alias("name")).agg(F.max_by("x.id", "place").alias("id"))
    attributes = attributes.select("report_id", F.lit("attribute").alias("kind"), "id", "name").where(named)
    trees = records.select(F.col("id").alias("report_id"), F.col("filter.tree").alias("tree")).where(F.startswith(F.ltrim("tree"), F.lit("{")))
    filters = names_in(trees, "report_id", "tree").select("report_id", F.lit("filter").alias("kind"), none.alias("id"), F.lower("name").alias("name"))
    return metrics.unionByName(tables).unionByName(filters).unionByName(attributes).distinct()


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """User activity as CSV with a header; blank counts are 0."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8").toDF(*ACTIVITY)
    for c in ("executions", "sessions", "errors"):
        raw = raw.withColumn(c, F.coalesce(F.expr(f"try_cast(replace({c}, ',', '') AS long)"), F.lit(0)))
    return raw


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """Activity by position: rows of 12 columns or more; bad counts are 0, bad times null."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"c{i} string" for i in range(12)), mode="PERMISSIVE")
    return raw.where("c11 IS NOT NULL").select(F.col("c0").alias("name"), F.col("c1").alias("path"), F.col("c2").alias("user"), F.coalesce(F.expr("try_cast(replace(c5, ',', '') AS long)"), F.lit(0)).alias("executions"), F.try_to_timestamp("c11", F.lit("M/d/yyyy H:mm")).alias("last"))


def read_ast_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, hash, kind): long keys are reports, short ones clusters."""
    raw = read_json_lists(spark, path)
    return raw.select("key", F.explode("values").alias("hash"), F.when(F.length("key") >= 30, "report").otherwise("ast_cluster").alias("kind"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, path string").json(path).where("coalesce(id, '') <> '' AND coalesce(path, '') <> ''")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new value of a column where it is not null; one row for a key in each input."""
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return a.join(b, on, "full").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in keys else F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns])


def replace_project(df: DataFrame, path: str) -> None:
    """Overwrite the projects that ``df`` holds, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def without_statement(reports: DataFrame, statements: DataFrame) -> DataFrame:
    """Ids of reports that have no statement."""
    known = statements.where(F.coalesce("sql", F.lit("")) != "").select("report_id")
    return reports.select("report_id").distinct().join(known, "report_id", "left_anti")


def without_features(reports: DataFrame, features: DataFrame, telemetry: DataFrame, unused: bool) -> DataFrame:
    """Reports without any feature and their executions, the most executed first; unused ones only if asked for."""
    rows = reports.join(features.select("report_id"), "report_id", "left_anti").join(telemetry.select("report_id", "execs"), "report_id", "left" if unused else "inner")
    return rows.orderBy(F.coalesce("execs", F.lit(0)).desc(), "report_id")


UNITS = "array<struct<id: string, name: string, subType: string, type: string, elements: array<struct<id: string, objectId: string, name: string, subType: string>>>>"


def definition_units(definitions: DataFrame) -> DataFrame:
    """``report_id``, ``kind`` (metric or attribute), ``id``, ``name``, ``sub_type``: the units of definitions (report_id, units), flat or in groups, each once."""
    unit = definitions.select("report_id", F.explode("units").alias("u"))
    flat = F.coalesce(F.size("u.elements"), F.lit(0)) <= 0
    alone = unit.where(flat & (F.coalesce("u.id", F.lit("")) != "") & (F.coalesce("u.name", F.lit("")) != ""))
    alone = alone.select("report_id", "u.id", "u.name", F.coalesce(F.nullif("u.subType", F.lit("")), "u.type").alias("sub_type"), F.col("u.type").alias("type"), F.lit(True).alias("flat"))
    inside = unit.where(~flat).select("report_id", F.col("u.type").alias("type"), F.explode("u.elements").alias("e"))
    inside = inside.select("report_id", F.coalesce(F.nullif("e.id", F.lit("")), "e.objectId").alias("id"), "e.name", F.coalesce(F.nullif("e.subType", F.lit("")), "type").alias("sub_type"), "type", F.lit(False).alias("flat"))
    low = F.lower(F.coalesce("sub_type", F.lit("")))
    metric = F.when(F.col("flat"), low == "metric").otherwise(F.contains(low, F.lit("metric"))) | (F.coalesce("type", F.lit("")) == "metrics")
    return alone.unionByName(inside).select("report_id", F.when(metric, "metric").otherwise("attribute").alias("kind"), "id", "name", "sub_type").distinct()


def to_recover(scope: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Ids whose attributes are still to be asked for."""
    return scope.select("report_id").distinct().join(done.select("report_id"), "report_id", "left_anti").join(failed.select("report_id"), "report_id", "left_anti")


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of both; of one key the old one, else the first of the new ones by ``order``."""
    rest = [c for c in old.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("r")).select(*keys, "r.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of both; of one key the last of the new ones by ``order``, else the old one."""
    rest = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("r")).select(*keys, "r.*")
    return last.select(*old.columns).unionByName(old.join(last.select(*keys), keys, "left_anti").select(*old.columns))


def audit(name: str, read: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row of the ingest log: rows read and loaded."""
    a = read.agg(F.count("*").alias("rows_read"))
    b = loaded.agg(F.count("*").alias("rows_loaded"))
    return a.crossJoin(b).select(F.lit(name).alias("source"), "rows_read", "rows_loaded")  # one row on either side


def grid_table(grid: DataFrame) -> DataFrame:
    """Grid cells as a flat table: rows (row, header_index, elements, raw, formatted) give a cell for each header, by element index, and for each metric, formatted before raw."""
    return grid.select("row", F.posexplode("header_index").alias("column", "at"), "elements").select("row", "column", F.get(F.get("elements", F.col("column")), F.col("at")).alias("value")).unionByName(grid.select("row", F.size("header_index").alias("first"), F.posexplode("raw").alias("m", "x"), "formatted").select("row", (F.col("first") + F.col("m")).alias("column"), F.coalesce(F.get("formatted", F.col("m")), F.col("x").cast("string")).alias("value")))


#: Names that emitted files have used for one column.
ALIASES = {"report_id": ["id", "reportId", "report_id"], "name": ["name", "reportName"], "execs": ["totalExecutions", "executions", "execs"], "group_id": ["groupId", "clusterId", "id"]}


def load_emitted(spark: SparkSession, path: str, columns: list[str], members: str | None = None) -> DataFrame:
    """An emitted JSON file as a table, whichever of the known names its columns have; with ``members``, a row for each member of a group."""
    raw = spark.read.json(path)

    def named(fields, prefix, c):
        found = [F.col(f"{prefix}{a}") for a in ALIASES.get(c, [c]) if a in fields]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(c)

    if members is None:
        return raw.select(*[named(raw.columns, "", c) for c in columns])
    rows = raw.select(named(raw.columns, "", "group_id"), F.explode(members).alias("m"))
    kind = rows.schema["m"].dataType
    if not hasattr(kind, "names"):  # plain ids
        return rows.select("group_id", F.col("m").alias("report_id"))
    return rows.select("group_id", *[named(kind.names, "m.", c) for c in columns])
