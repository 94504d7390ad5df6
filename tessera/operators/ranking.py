"""Rankings, canonical members and numbering that scale with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.storage import materialize


def canonical(id_: str, weight: str) -> Column:
    """Aggregate: the id of greatest weight, the least id of several (an aggregate, so hot groups combine early)."""
    return F.min_by(id_, F.struct((-F.coalesce(F.col(weight), F.lit(0))).alias("w"), F.col(id_).alias("i")))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the given total order, without one task that holds all rows."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "numbered")
    before, sofar = [], 0
    for r in parts.groupBy("__part").count().orderBy("__part").collect():  # one row for each partition
        before.append((r["__part"], sofar))
        sofar += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """Up to n rows of each group; Spark cuts each task's part of a group to n rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def placed(df: DataFrame, group: str, name: str, *order: Column) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group, without one task that holds all rows of a group.  The order must be total within the group, a null group is a group."""
    rows = materialize(numbered(df, "__number", F.col(group), *order), "placed")
    first = rows.groupBy(F.col(group).alias("__group")).agg(F.min("__number").alias("__first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__number") - F.col("__first") + 1).drop("__number", "__group", "__first")


def primary_first(members: DataFrame) -> DataFrame:
    """Rows (cluster, id, primary, cosine, execs) with ``place``: the primary, then those with a cosine from the greatest on, then the others from the most executions on; ties by id."""
    others = F.when(F.col("id") == F.col("primary"), 0).otherwise(1)
    return placed(members, "cluster", "place", others, F.col("cosine").desc_nulls_last(), F.coalesce("execs", F.lit(0)).desc(), F.col("id"))
