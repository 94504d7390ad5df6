"""Two clusterings of the same reports side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a report can be, in order of interest.
CATEGORIES = ["both", "semanticOnly", "jaccardOnly", "neither"]


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"))


def side_by_side(universe: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Each report of ``universe`` (report_id, ...) with ``category``, and cluster and size in either clustering (report_id, cluster_id; one row for a report)."""
    rows = universe
    for name, members in (("jaccard", first), ("semantic", second)):
        found = members.join(sizes(members), "cluster_id").select("report_id", F.col("cluster_id").alias(f"{name}_cluster"), F.col("size").alias(f"{name}_size"))
        rows = rows.join(found, "report_id", "left")
    a, b = F.col("jaccard_cluster").isNotNull(), F.col("semantic_cluster").isNotNull()
    return rows.withColumn("category", F.when(a & b, "both").when(b, "semanticOnly").when(a, "jaccardOnly").otherwise("neither"))


def in_order(rows: DataFrame) -> DataFrame:
    """By category, then from the most executions on, then by id."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return rows.orderBy(rank, F.coalesce("execs", F.lit(0)).desc(), "report_id")


def overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """``a``, ``b``, ``shared``, ``size_a``, ``size_b``, ``jaccard`` of each two clusters that share a report.

    Reports bring one row each to the join, and a pair of clusters is a sum over
    them, so the table has as many cells as there are pairs that meet.
    """
    met = first.select("report_id", F.col("cluster_id").alias("a")).join(second.select("report_id", F.col("cluster_id").alias("b")), "report_id")
    cells = met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    cells = cells.join(sizes(first).toDF("a", "size_a"), "a").join(sizes(second).toDF("b", "size_b"), "b")
    return cells.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))


def partners(cells: DataFrame) -> DataFrame:
    """``side``, ``cluster_id``, ``partner``, ``jaccard``, ``mutual``: the cluster most alike on the other side, the least of equal ones, and whether each is the other's."""
    best_a = cells.groupBy("a").agg(F.min_by(F.struct("b", "jaccard"), F.struct(-F.col("jaccard"), "b")).alias("p")).select("a", F.col("p.b").alias("b"), F.col("p.jaccard").alias("jaccard"))
    best_b = cells.groupBy("b").agg(F.min_by(F.struct("a", "jaccard"), F.struct(-F.col("jaccard"), "a")).alias("p")).select("b", F.col("p.a").alias("a"), F.col("p.jaccard").alias("jaccard"))
    mutual = best_a.join(best_b, ["a", "b"], "left_semi").select("a", "b").withColumn("mutual", F.lit(True))
    out = [x.join(mutual, ["a", "b"], "left").select(F.lit(side).alias("side"), F.col(own).alias("cluster_id"), F.col(other).alias("partner"), "jaccard", F.coalesce("mutual", F.lit(False)).alias("mutual")) for x, side, own, other in ((best_a, "jaccard", "a", "b"), (best_b, "semantic", "b", "a"))]
    return out[0].unionByName(out[1])


def final_counts(members: DataFrame, base: DataFrame) -> DataFrame:
    """One row: clusters of several members, members, singletons (the base less members, not below 0), and what is left if each cluster becomes one."""
    n = members.agg(F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("report_id").alias("members"))
    b = base.agg(F.countDistinct("report_id").alias("base"))
    singles = F.greatest(F.lit(0).cast("long"), F.col("base") - F.col("members"))
    return n.crossJoin(b).select("clusters", "members", singles.alias("singletons"), (F.col("clusters") + singles).alias("final"))  # one row on either side
