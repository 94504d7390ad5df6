"""Stages that collapse redundant reports: groups, members and canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import canonical

MIN_SIGNAL = 3


def feature_sets(features: DataFrame) -> DataFrame:
    """``report_id``, ``m``, ``t``, ``f``: sorted sets of lower-case names from rows (report_id, m, t, f)."""
    return features.groupBy("report_id").agg(*[F.array_sort(F.collect_set(F.lower(c))).alias(c) for c in "mtf"])


def groups_by(rows: DataFrame, keys: list[Column], least: int = 2) -> DataFrame:
    """``report_id``, ``group_size``, ``canonical_id``, ``total_execs`` of each member of a group of >= least equal keys.

    The groups are aggregated first, then joined to the members, so no window
    holds a hot group in one task.
    """
    keyed = rows.select("report_id", "execs", F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}), 256).alias("group_key"))
    groups = keyed.groupBy("group_key").agg(F.count("*").alias("group_size"), F.sum("execs").alias("total_execs"), canonical("report_id", "execs").alias("canonical_id")).where(F.col("group_size") >= least)
    return keyed.join(groups, "group_key").select("report_id", "group_size", "canonical_id", "total_execs", "group_key")


def fingerprint(sets: DataFrame) -> DataFrame:
    """Groups of equal feature triples with enough signal; rows (report_id, execs, m, t, f)."""
    signal = F.size("m") + F.size("t") + F.size("f") >= MIN_SIGNAL
    return groups_by(sets.where(signal), [F.col(c) for c in "mtf"])


def collapsed(members: DataFrame) -> DataFrame:
    """Members that another one stands for."""
    return members.where(F.col("report_id") != F.col("canonical_id"))


def survivors(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows that are in no group or are their group's canonical member."""
    gone = collapsed(members).select("report_id")
    return rows.join(gone, "report_id", "left_anti")


def collisions(rows: DataFrame) -> DataFrame:
    """Two passes over (report_id, name, execs, last, tier); adds ``canonical_id`` and ``pass``.

    Pass 1 joins reports with equal executions and last execution if they have
    one normalised name, or if a fuzzy match is among three or more.  Pass 2
    joins what is left by name and executions; unused reports stay apart.
    """
    from tessera.functions.text import norm_name

    rows = rows.withColumn("norm", norm_name(F.col("name")))
    order = F.struct(F.when(F.col("tier") == "exact", 0).otherwise(1).alias("t"), F.length("norm").alias("l"), F.col("report_id").alias("i"))
    used = rows.where("execs > 0")
    first = used.groupBy("execs", "last").agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.bool_or(F.col("tier") == "fuzzy").alias("fuzzy"), F.min_by("report_id", order).alias("canonical_id"))
    first = first.where((F.col("n") >= 2) & ((F.col("low") == F.col("high")) | (F.col("fuzzy") & (F.col("n") >= 3)))).select("execs", "last", F.col("canonical_id").alias("c1"))
    a, b = rows.alias("a"), first.alias("b")
    marked = a.join(b, (F.col("a.execs") > 0) & (F.col("a.execs") == F.col("b.execs")) & F.col("a.last").eqNullSafe(F.col("b.last")), "left").select("a.*", "c1")
    left = marked.where(F.col("c1").isNull() | (F.col("c1") == F.col("report_id")))
    second = left.where("execs > 0").groupBy("norm", "execs").agg(F.count("*").alias("n"), F.min_by("report_id", F.struct(F.when(F.col("tier") == "exact", 0).otherwise(1).alias("t"), F.col("report_id").alias("i"))).alias("c2")).where("n >= 2").drop("n")
    out = marked.join(second, ["norm", "execs"], "left")
    gone1 = F.col("c1").isNotNull() & (F.col("c1") != F.col("report_id"))
    gone2 = ~gone1 & F.col("c2").isNotNull() & (F.col("c2") != F.col("report_id"))
    return out.select("report_id", F.when(gone1, F.col("c1")).when(gone2, F.col("c2")).otherwise(F.col("report_id")).alias("canonical_id"), F.when(gone1, 1).when(gone2, 2).otherwise(0).alias("pass"))


def drift(rows: DataFrame, key: str, id_: str = "report_id") -> DataFrame:
    """``key``, ``fingerprint``: the number of ids and a sum of their hashes, which no order changes and tasks add up."""
    ids = rows.select(key, id_).distinct()
    part = F.conv(F.substring(F.md5(F.col(id_).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return ids.groupBy(key).agg(F.concat(F.lit("n="), F.count("*"), F.lit(";"), F.sum(part)).alias("fingerprint"))


def merged_inventory(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by report_id: a new one, the least of several, is added only if its id is absent."""
    from tessera.sources.inventory import first_wins

    return first_wins(old, new, ["report_id"])


def representatives(rows: DataFrame, key: str, id_: str = "report_id") -> DataFrame:
    """The least id of each key, and how many rows it stands for."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias(id_), F.count("*").alias("n"))
