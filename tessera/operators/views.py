"""Filtered and sorted lists of reports, clusters and domains, as a user asks for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import canonical, placed, top_per_group

#: Rows that a list shows at most; limits are part of these features.
LIST_ROWS, COMPARISON_ROWS, SINGLETONS, SAMPLE = 20_000, 2_000, 500, 25


def found_in(search: str, *columns: str) -> Column:
    """Whether some column contains the search text, without regard to case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(search.lower())) for c in columns])


def found_in_members(search: str, members: str, *fields: str) -> Column:
    """Whether a member of a nested array contains the search text in some field."""
    return F.exists(members, lambda m: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(m[f].cast("string"), F.lit(""))), F.lit(search.lower())) for f in fields]))


def report_list(reports: DataFrame, ids: DataFrame | None = None, source: str | None = None, search: str = "", place: str | None = None, more_users_than: int | None = None, more_execs_than: int | None = None, sort: str = "execs", most: int = LIST_ROWS) -> DataFrame:
    """Reports of a scope that pass all filters; source ``none`` means blank, place ``public`` or ``personal``, limits are strict."""
    if ids is not None:
        reports = reports.join(ids, "report_id", "left_semi")
    if source is not None:
        reports = reports.where(F.coalesce("source_type", F.lit("")) == ("" if source == "none" else source))
    if search:
        reports = reports.where(found_in(search, "name", "owner", "path"))
    if place is not None:
        reports = reports.where(F.contains(F.lower("path"), F.lit({"public": "/public", "personal": "/profiles/"}[place])))
    for column, more in (("users", more_users_than), ("execs", more_execs_than)):
        if more is not None:
            reports = reports.where(F.col(column) > more)
    order = [F.lower("name")] if sort == "name" else [F.desc(sort)]
    return reports.orderBy(*order, "report_id").limit(most)


def drill_down(reports: DataFrame, status: str | None = None, bucket: str | None = None, source: str | None = None, search: str = "") -> DataFrame:
    for column, value in (("status", status), ("bucket", bucket), ("source_type", source)):
        if value is not None:
            reports = reports.where(F.col(column) == value)
    return reports.where(found_in(search, "name", "owner", "path", "report_id")) if search else reports


def comparison(rows: DataFrame, category: str | None, search: str, fields: list[str], most: int = COMPARISON_ROWS) -> DataFrame:
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if search:
        rows = rows.where(found_in(search, *fields))
    return rows.orderBy(F.desc("execs"), "id").limit(most)


def clusters_matching(clusters: DataFrame, search: str, columns: list[str], members: str, fields: list[str], action: str | None = None) -> DataFrame:
    """Clusters that a search finds in a column of their own or in a member, with a reviewer's action if one is asked for."""
    if action is not None:
        clusters = clusters.where(F.coalesce("action", F.lit("UNKNOWN")) == action)
    return clusters.where(found_in(search, *columns) | found_in_members(search, members, *fields)) if search else clusters


def with_statement(members: DataFrame, statements: DataFrame, extracted: bool) -> DataFrame:
    """Members whose statement is there, or is missing."""
    known = statements.where(F.coalesce("sql", F.lit("")) != "").select("report_id")
    return members.join(known, "report_id", "left_semi" if extracted else "left_anti")


def breakdown(reports: DataFrame) -> DataFrame:
    """Reports (source_type, status, final) by source: all, active, finally kept."""
    return reports.groupBy("source_type").agg(F.count("*").alias("overall"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("final")).alias("final"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``facet``, ``value``, ``n``: rows by each value of each column, in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(each)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def domains(rows: DataFrame) -> DataFrame:
    """Classified reports (report_id, domain, confidence) by domain, with the surest one."""
    return rows.groupBy("domain").agg(F.count("*").alias("size"), F.avg("confidence").alias("confidence"), F.min("confidence").alias("least"), canonical("report_id", "confidence").alias("primary_id"))


def latest_domains(rows: DataFrame) -> DataFrame:
    """The last classification of each report (report_id, domain, confidence, at)."""
    last = F.max_by(F.struct("domain", "confidence", "at"), F.struct("at", "domain"))
    return rows.groupBy("report_id").agg(last.alias("r")).select("report_id", "r.*")


def sampled_members(members: DataFrame, group: str, most: int = SAMPLE) -> DataFrame:
    """``group``, ``lines``: the names of a group's most executed members, and how many more there are; each task sends ``most`` of a group at most."""
    n = members.groupBy(group).agg(F.count("*").alias("n"))
    top = top_per_group(members.select(group, "name", "execs", "report_id"), [group], most, F.desc("execs"), F.asc("name"), F.asc("report_id"))
    names = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("m"))
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("+"), F.col("n") - most, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return n.join(names, group).select(group, F.concat(F.transform("m", lambda x: x["name"]), more).alias("lines"))


def ordered_members(members: DataFrame, group: str, primary: str, score: str | None = None) -> DataFrame:
    """Adds ``place``: the primary first, then by score (if any) or executions, ties by id; a group of any size is placed by many tasks."""
    first = F.when(F.col("report_id") == F.col(primary), 0).otherwise(1)
    order = [F.desc_nulls_last(score)] if score else []
    return placed(members, group, "place", first, *order, F.coalesce("execs", F.lit(0)).desc(), F.col("report_id"))


def top_unique_names(reports: DataFrame, most: int = 15) -> DataFrame:
    """The most executed names, each once by its most executed report."""
    one = reports.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max("execs").alias("execs"), canonical("report_id", "execs").alias("report_id"))
    return one.orderBy(F.desc("execs"), "report_id").limit(most)
