"""Small tables that sum a run up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sets import cosine, dot
from tessera.functions.text import family_base
from tessera.operators.ranking import canonical


def filled(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) != ""


def canonical_paths(members: DataFrame) -> DataFrame:
    """``group_id``, ``path`` from (group_id, report_id, canonical_id, path): the canonical member's path, else that of the first member by id that has one, else empty."""
    own = F.max(F.when((F.col("report_id") == F.col("canonical_id")) & filled("path"), F.col("path")))
    first = F.min_by("path", F.when(filled("path"), F.col("report_id")))
    return members.groupBy("group_id").agg(F.coalesce(own, first, F.lit("")).alias("path"))


def with_features(members: DataFrame, **features: DataFrame) -> DataFrame:
    """Members (report_id, ...) with a sorted array for each kind of feature (report_id, name), empty where there is none."""
    out = members
    for kind, rows in features.items():
        arrays = rows.groupBy("report_id").agg(F.array_sort(F.collect_set("name")).alias(kind))
        out = out.join(arrays, "report_id", "left").withColumn(kind, F.coalesce(kind, F.array().cast("array<string>")))
    return out


def replaced_features(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Features (report_id, kind, id, name) in which those of reports in ``fresh`` (report_id, kind, items: array of id and name) are replaced.

    Of one name in a list the first item counts; items without a name go.  A
    report of ``fresh`` with an empty list has no features of any kind left.
    """
    items = fresh.select("report_id", "kind", F.posexplode("items").alias("place", "x")).where(filled("x.name"))
    new = items.groupBy("report_id", "kind", F.col("x.name").alias("name")).agg(F.min_by("x.id", "place").alias("id"))
    return old.join(fresh.select("report_id"), "report_id", "left_anti").select("report_id", "kind", "id", "name").unionByName(new)


def feature_totals(features: DataFrame, kind: str) -> DataFrame:
    return features.where(F.col("kind") == kind).groupBy("report_id").agg(F.count("*").alias("n"))


def families(reports: DataFrame) -> DataFrame:
    """One row for reports (report_id, name, execs, place): families of several variants, their members, reducible variants, what is left after consolidation, and that by place (Other if null) as a map."""
    base = reports.withColumn("base", family_base(F.trim("name"))).groupBy("base").agg(F.count("*").alias("n"), canonical("report_id", "execs").alias("id"))
    kept = base.join(reports.select(F.col("report_id").alias("id"), F.coalesce("place", F.lit("Other")).alias("place")), "id")
    several = F.col("n") >= 2
    by = kept.groupBy("place").agg(F.count("*").alias("left"), F.count_if(several).alias("families"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("members"))
    return by.agg(F.coalesce(F.sum("families"), F.lit(0)).alias("families"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.coalesce(F.sum("members") - F.sum("families"), F.lit(0)).alias("reducible"), F.coalesce(F.sum("left"), F.lit(0)).alias("consolidated"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("place", "left")))).alias("by_place"))


def structural_removal(sql_groups: DataFrame, syntax_groups: DataFrame) -> DataFrame:
    """One row: reducible by equal statements and by equal shapes (groups with ``size``), and the greater of both, for the groups overlap."""
    parts = [g.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias(name)) for name, g in (("by_statement", sql_groups), ("by_shape", syntax_groups))]
    return parts[0].crossJoin(parts[1]).withColumn("removed", F.greatest("by_statement", "by_shape"))  # one row on either side


def histogram(rows: DataFrame, column: str, missing: str = "?") -> DataFrame:
    """``column``, ``n``; null and empty values count as ``missing``."""
    return rows.groupBy(F.when(filled(column), F.col(column)).otherwise(missing).alias(column)).agg(F.count("*").alias("n"))


def totals(groups: DataFrame, users: DataFrame) -> DataFrame:
    """One row over groups (size) and users (execs, service): sums of reducible and size, executions of people and of services, and services."""
    g = groups.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("reducible"), F.coalesce(F.sum("size"), F.lit(0)).alias("reports"))
    u = users.agg(F.coalesce(F.sum(F.when(~F.col("service"), F.col("execs"))), F.lit(0)).alias("human_execs"), F.coalesce(F.sum(F.when(F.col("service"), F.col("execs"))), F.lit(0)).alias("service_execs"), F.count_if("service").alias("services"))
    return g.crossJoin(u)  # one row on either side


def statements_per_cluster(members: DataFrame, statements: DataFrame) -> DataFrame:
    """``cluster_id``, ``n``, ``execs``: members that have a statement, and all members' executions."""
    known = statements.where(filled("sql")).select("report_id").distinct().withColumn("has", F.lit(1))
    return members.join(known, "report_id", "left").groupBy("cluster_id").agg(F.count("has").alias("n"), F.coalesce(F.sum("execs"), F.lit(0)).alias("execs"))


def singletons(rows: DataFrame, members: DataFrame, name: str = "SINGLETONS") -> DataFrame:
    """The row for all reports (report_id, name, execs, users) outside the clusters: id, size, sums, and the most executed one's name; none if there are none."""
    alone = rows.join(members.select("report_id"), "report_id", "left_anti")
    out = alone.agg(F.count("*").alias("size"), F.coalesce(F.sum("execs"), F.lit(0)).alias("execs"), F.coalesce(F.sum("users"), F.lit(0)).alias("users"), F.min_by("name", F.struct(-F.coalesce("execs", F.lit(0)), "report_id")).alias("example"))
    return out.where("size > 0").select(F.lit(name).alias("cluster_id"), "size", "execs", "users", F.coalesce("example", F.lit("")).alias("example"))


def singleton_list(rows: DataFrame, members: DataFrame, most: int = 500) -> DataFrame:
    """The first reports by id outside the clusters, to be shown; counts come from ``singletons``."""
    return rows.join(members.select("report_id"), "report_id", "left_anti").select("report_id").orderBy("report_id").limit(most)


def parent_reports(reports: DataFrame, copies: DataFrame) -> DataFrame:
    """``report_id``, ``name``, ``copies``, ``children``, ``size`` of reports that are nobody's copy, from copies (report_id, parent_id), the largest family first, then by name in small letters."""
    n = copies.where("report_id <> parent_id").select("report_id", "parent_id").distinct().groupBy(F.col("parent_id").alias("report_id")).agg(F.count("*").alias("children"))
    rows = reports.join(copies.where("report_id <> parent_id").select("report_id"), "report_id", "left_anti").join(n, "report_id", "left")
    children = F.coalesce("children", F.lit(0))
    return rows.select("report_id", "name", (children + 1).alias("copies"), children.alias("children"), (children + 1).alias("size")).orderBy(F.desc("size"), F.lower("name"), "report_id")


STUB = "struct<id: string, objectId: string, name: string, type: int, subType: string, description: string, dateCreated: string, dateModified: string, owner: string, path: string>"
DEFINITION = "struct<information: struct<objectId: string, name: string, subType: string, dateCreated: string, dateModified: string, versionId: string>, dataSource: struct<filter: struct<text: string, tree: string>>>"


def stubs(items: DataFrame) -> DataFrame:
    """Report stubs from JSON texts (value): the id or else the object's id, and the owner's name where the owner is an object."""
    s = F.from_json("value", STUB)
    rows = items.select(s.alias("s"))
    owner = F.when(F.startswith(F.ltrim("s.owner"), F.lit("{")), F.get_json_object("s.owner", "$.name")).otherwise(F.col("s.owner"))
    return rows.select(F.when(filled("s.id"), F.col("s.id")).otherwise(F.col("s.objectId")).alias("id"), *[f"s.{c}" for c in ("name", "type", "subType", "description", "dateCreated", "dateModified")], owner.alias("owner"), "s.path")


def definitions(items: DataFrame) -> DataFrame:
    """``id``, ``name``, ``sub_type``, ``version``, ``filter_text``, ``filter_tree`` from definitions as JSON texts (value)."""
    r = items.select(F.from_json("value", DEFINITION).alias("d"))
    info, found = "d.information", "d.dataSource.filter"
    return r.select(F.col(f"{info}.objectId").alias("id"), F.col(f"{info}.name").alias("name"), F.col(f"{info}.subType").alias("sub_type"), F.col(f"{info}.versionId").alias("version"), F.col(f"{found}.text").alias("filter_text"), F.col(f"{found}.tree").alias("filter_tree"))


def experiment_rows(clusters: DataFrame, members: DataFrame, everyone: DataFrame) -> DataFrame:
    """Clusters of an experiment in the shape of semantic clusters: ``id``, ``size``, ``primary_id``, ``primary_name``, ``execs``, ``users``, ``least_cosine``, ``singletons``.

    Clusters (id, primary_id), members (id, report_id, vector), everyone
    (report_id, name, execs, users).  ``least_cosine`` is the least of the
    members' cosines to the primary, to four places; zero and missing vectors
    have none.  Reports outside all clusters make up one row XSING.
    """
    of_primary = clusters.join(members.select("id", F.col("report_id").alias("primary_id"), F.col("vector").alias("v")), ["id", "primary_id"], "left").select("id", "primary_id", "v")
    rows = members.join(of_primary, "id").join(everyone, "report_id", "left")
    norm = dot(F.col("vector"), F.col("vector")) * dot(F.col("v"), F.col("v"))
    away = F.when(F.col("report_id") == F.col("primary_id"), F.lit(1.0)).when(norm > 0, F.round(cosine(F.col("vector"), F.col("v")), 4))
    own = rows.withColumn("away", away).groupBy("id", "primary_id").agg(F.count("*").alias("size"), F.coalesce(F.sum("execs"), F.lit(0)).alias("execs"), F.coalesce(F.sum("users"), F.lit(0)).alias("users"), F.min("away").alias("least_cosine"), F.max(F.when(F.col("report_id") == F.col("primary_id"), F.col("name"))).alias("primary_name"))
    own = own.select("id", "size", "primary_id", F.coalesce("primary_name", F.lit("")).alias("primary_name"), "execs", "users", "least_cosine", F.lit(False).alias("singletons"))
    alone = everyone.join(members.select("report_id"), "report_id", "left_anti")
    rest = alone.agg(F.count("*").alias("size"), F.min("report_id").alias("primary_id"), F.min_by("name", "report_id").alias("primary_name"), F.coalesce(F.sum("execs"), F.lit(0)).alias("execs"), F.coalesce(F.sum("users"), F.lit(0)).alias("users")).where("size > 0")
    return own.unionByName(rest.select(F.lit("XSING").alias("id"), "size", "primary_id", F.coalesce("primary_name", F.lit("")).alias("primary_name"), "execs", "users", F.lit(None).cast("double").alias("least_cosine"), F.lit(True).alias("singletons")))
