"""A project in few words: counts, and the heads of its lists within a size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How many rows of each list are shown at most.
MOST = {"finalKeptTop": 50, "jaccardTopClusters": 20, "semanticTopClusters": 20, "familyTop": 15}


def heads(lists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``list``, ``rank``, ``value`` (a row as JSON): the first rows of each list (rows, shown columns), the largest ``weight`` first, ties by ``id``."""
    tops = []
    for name, (rows, shown) in lists.items():
        top = rows.orderBy(F.coalesce("weight", F.lit(0)).desc(), F.col("id")).limit(MOST[name])
        order = Window.orderBy(F.coalesce("weight", F.lit(0)).desc(), F.col("id"))  # of at most MOST rows
        tops.append(top.select(F.lit(name).alias("list"), F.row_number().over(order).alias("rank"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value")))
    return reduce(DataFrame.unionByName, tops)


def within(rows: DataFrame, budget: int) -> DataFrame:
    """The rows that fit into ``budget`` characters, taken by rank from all lists in turn; a row that does not fit ends its list."""
    order = Window.orderBy("rank", "list")  # of at most as many rows as the lists show
    fits = F.sum(F.length("value") + 1).over(order) <= budget
    ended = Window.partitionBy("list").orderBy("rank")
    return rows.withColumn("fits", fits).withColumn("fits", F.min("fits").over(ended)).where("fits").drop("fits")


def condensed(reports: DataFrame, clusters: DataFrame, semantic: DataFrame, families: DataFrame, budget: int = 40_000) -> DataFrame:
    """One row: counts by status and source, numbers of clusters and families, and the heads of the four lists as JSON arrays.

    Reports (id, name, source_type, status, final, weight), clusters and semantic
    clusters (id, name, size as weight), families (id, reducible, size as weight).
    Each list is cut to its head in the tasks; only the heads meet in one.
    """
    source = F.coalesce(F.nullif(F.trim("source_type"), F.lit("")), F.lit("unknown"))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("active"))
    by = reports.groupBy(source.alias("source_type"), status.alias("status"), F.coalesce("final", F.lit(False)).alias("final")).agg(F.count("*").alias("n"))

    def counts(name: str, key: str, which: Column) -> DataFrame:
        per = by.where(which).groupBy(key).agg(F.sum("n").alias("n"))
        return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    parts = [counts("overall", "source_type", F.lit(True)), counts("active", "source_type", F.col("status") == "active"), counts("finalKept", "source_type", F.col("final")), counts("statusBreakdown", "status", F.lit(True))]
    parts.append(by.agg(F.coalesce(F.sum(F.when(F.col("final"), F.col("n"))), F.lit(0)).alias("finalKeptCount")))
    parts += [rows.agg(F.count("*").alias(name)) for name, rows in (("jaccardClusterCount", clusters), ("semanticClusterCount", semantic), ("familyCount", families))]
    shown = ["id", "name", F.col("weight").alias("executions"), "source_type", "status"]
    of_cluster = ["id", "name", F.col("weight").alias("size")]
    lists = {"finalKeptTop": (reports.where("final"), shown), "jaccardTopClusters": (clusters, of_cluster), "semanticTopClusters": (semantic, of_cluster), "familyTop": (families, ["id", F.col("weight").alias("size"), "reducible"])}
    kept = within(heads(lists), budget)
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ","), F.lit("]"))
    tops = kept.groupBy().pivot("list", list(MOST)).agg(text)
    tops = tops.select(*[F.coalesce(c, F.lit("[]")).alias(c) for c in MOST])
    return reduce(DataFrame.crossJoin, [*parts, tops])  # one row on either side
