"""What a report depends on, grouped for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_groups(dependencies: DataFrame, first: Sequence[str]) -> DataFrame:
    """``report_id``, ``type``, ``place``, ``label``, ``objects`` from rows (report_id, type, name).

    A report's types stand in the order of ``first``, the others after them by
    name.  A type with one object is labelled by its name, another by the type and
    the number of objects.  Rows are aggregated before they are ordered, so a
    report has as many rows to order as there are types.
    """
    groups = dependencies.groupBy("report_id", "type").agg(F.count("*").alias("objects"), F.min("name").alias("name"))
    at = F.array_position(F.array(*map(F.lit, first)), F.col("type")) if first else F.lit(0)
    rank = F.when(at > 0, at).otherwise(len(first) + 1)
    place = F.row_number().over(Window.partitionBy("report_id").orderBy(rank, "type")).cast("long")
    label = F.when(F.col("objects") == 1, F.col("name")).otherwise(F.format_string("%ss (%d)", "type", "objects"))
    return groups.select("report_id", "type", place.alias("place"), label.alias("label"), "objects")
