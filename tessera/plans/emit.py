"""The tables that a run is handed out as, flat or nested; ``write`` puts them in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sets import jaccard
from tessera.operators import dedup
from tessera.operators.funnel import Result
from tessera.sources.inventory import write_json


def reports(result: Result, features: DataFrame) -> DataFrame:
    """Every report once, with status, survivor, and counts of its features."""
    sets = dedup.feature_sets(features).select("report_id", *[F.size(c).alias(f"n_{c}") for c in "mtf"])
    first = result.inventory.groupBy("report_id").agg(F.min("name").alias("name"))
    rows = first.join(result.survivors(), "report_id").join(sets, "report_id", "left")
    status = F.when(F.col("stage") == "telemetry", "retired").when(F.col("stage").isNotNull(), "collapsed").otherwise("active")
    return rows.select("report_id", "name", status.alias("status"), "stage", "survivor_id", *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in "mtf"])


def inventory_all(result: Result) -> DataFrame:
    used = result.kept["universe"].select("report_id", "execs")
    return result.inventory.join(used, "report_id", "left").withColumn("active", F.col("execs").isNotNull())


def retired(result: Result, batches: list[str]) -> DataFrame:
    """Reports that were never used, or lie in a retired batch, with the bucket that tells which."""
    rows = result.inventory.join(result.kept["universe"].select("report_id"), "report_id", "left_anti")
    return rows.withColumn("bucket", F.when(F.col("batch").isin(batches), "batch").otherwise("telemetry"))


def groups(result: Result, stage: str) -> DataFrame:
    """Groups of a stage: canonical id, members by executions, size, how many may go, all executions.

    A group is one row here because it is handed out as one; nothing else needs its members in one place.
    """
    rows = result.members[stage].join(result.kept["universe"].select("report_id", "name", "execs"), "report_id")
    members = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("execs")).alias("e"), "report_id", "name"))), lambda m: F.struct(m["report_id"].alias("report_id"), m["name"].alias("name"), (-m["e"]).alias("execs")))
    out = rows.groupBy("canonical_id").agg(members.alias("members"), F.count("*").alias("size"), F.sum("execs").alias("execs")).where("size >= 2")
    return out.withColumn("reducible", F.col("size") - 1)


def similarities(result: Result) -> DataFrame:
    """Links between representatives of equal feature sets."""
    return result.links["similarity"].orderBy(F.desc("score"), "a", "b")


def compared(pairs: DataFrame) -> DataFrame:
    """Rows (m, t, f, m2, t2, f2) with the overall percent and the reasons for it."""
    score = {c: jaccard(F.col(c), F.col(f"{c}2")) for c in "mtf"}
    reasons = [F.when((s == 1) & (F.size(c) > 0), f"all {name}").when((s >= 0.75) & (F.size(c) > 0), f"most {name}") for (c, s), name in zip(score.items(), ("metrics", "tables", "filters"), strict=True)]
    return pairs.withColumn("overall", F.lit(100) * (F.lit(0.4) * score["m"] + F.lit(0.4) * score["t"] + F.lit(0.2) * score["f"])).withColumn("reasons", F.concat_ws(";", *reasons))


def write(result: Result, features: DataFrame, folder: str, retired_batches: list[str]) -> None:
    """All tables of a run as JSON below a folder."""
    tables = {"summary": result.counts(), "reports": reports(result, features), "inventory_all": inventory_all(result), "retired": retired(result, retired_batches), "outcomes": result.outcomes()}
    tables |= {stage: groups(result, stage) for stage in result.members}
    if "similarity" in result.links:
        tables["similarities"] = similarities(result)
    for name, table in tables.items():
        write_json(table, f"{folder}/{name}")
