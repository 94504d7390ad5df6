"""What several projects share: names, statements, tables, metrics and families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``projects``, ``reports``, ``projects_csv`` of the keys of two or more projects, from rows with that column and ``project``.

    Null and empty keys are nobody's.  Rows are counted by key and project first,
    so a common key brings one row for each project to its group.
    """
    each = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key, "project").agg(F.count("*").alias("reports"))
    found = each.groupBy(key).agg(F.count("project").alias("projects"), F.sum("reports").alias("reports"), F.array_join(F.array_sort(F.collect_list("project")), ",").alias("projects_csv"))
    return found.where("projects >= 2")


def members(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key several projects share."""
    return rows.join(shared(rows, key).select(key), key, "left_semi")
