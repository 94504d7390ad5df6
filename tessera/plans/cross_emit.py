"""What projects share, as the six tables that it is handed out in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import cross_project
from tessera.operators.ranking import numbered, placed
from tessera.sources.inventory import write_json
from tessera.storage import materialize

#: Members in one row of a group, at most; a larger group goes on in further rows with the same id and the next ``part``.
MEMBERS_A_ROW = 1000


@dataclass
class Kind:
    """``rows`` have ``key``, ``project`` and, if members are handed out, ``report_id`` and what else they show; ``letters`` begin the groups' ids."""

    rows: DataFrame
    key: str
    letters: str | None = None
    by_projects: bool = True


def groups(kind: Kind) -> DataFrame:
    """``n`` (by order), key, ``nProjects``, ``nReports``, ``projects``: one row for each key that several projects have."""
    order = [*([F.desc("projects")] if kind.by_projects else []), F.desc("reports"), F.col("key")]
    found = numbered(cross_project.shared(kind.rows, "key"), "n", *order)
    return found.select("n", "key", F.col("projects").alias("nProjects"), F.col("reports").alias("nReports"), F.split("projects_csv", ",").alias("projects"))


def nested(kind: Kind, found: DataFrame, *shown: Column) -> DataFrame:
    """Groups with their members, MEMBERS_A_ROW in a row, by project and report."""
    rows = kind.rows.join(found.select("key", "n"), "key").select("n", "project", "report_id", F.struct(F.col("project").alias("projectId"), F.col("report_id").alias("reportId"), *shown).alias("m"))
    # repeated rows are told apart by what they show, or not at all
    rows = placed(rows, "n", "place", F.col("project"), F.col("report_id"), F.to_json("m"))
    parts = rows.groupBy("n", F.floor((F.col("place") - 1) / MEMBERS_A_ROW).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("s"))
    parts = parts.select("n", "part", F.transform("s", lambda x: x["m"]).alias("members"))
    name = F.concat(F.lit(kind.letters), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(5), F.length(F.col("n").cast("string"))), F.lit("0")))
    return found.join(parts, "n").select(name.alias("id"), F.col("key").alias(kind.key), "nProjects", "nReports", "projects", "part", "members")


def tables(names: DataFrame, statements: DataFrame, source_tables: DataFrame, metrics: DataFrame, families: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """The six tables by name.

    Names (key, project, report_id, name, path, executions), statements (key,
    project, report_id), tables, metrics and families (key, project), projects
    (project).  ``summary`` has one row.
    """
    kinds = {"name_matches": Kind(names, "normalizedName", "NM"), "sql_matches": Kind(statements, "sqlHash", "SH", by_projects=False), "shared_tables": Kind(source_tables, "tableName"), "shared_metrics": Kind(metrics, "metricName"), "shared_families": Kind(families, "familyBase")}
    found = {n: materialize(groups(k), n) for n, k in kinds.items()}
    out = {
        "name_matches": nested(kinds["name_matches"], found["name_matches"], F.coalesce("name", F.lit("")).alias("name"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("executions", F.lit(0)).alias("executions")),
        "sql_matches": nested(kinds["sql_matches"], found["sql_matches"]),
    }
    for n, count in (("shared_tables", "nReferences"), ("shared_metrics", "nReferences"), ("shared_families", "nReports")):
        out[n] = found[n].orderBy("n").select(F.col("key").alias(kinds[n].key), "nProjects", F.col("nReports").alias(count), "projects")
    words = {"name_matches": "nameMatches", "sql_matches": "sqlMatches", "shared_tables": "sharedTables", "shared_metrics": "sharedMetrics", "shared_families": "sharedFamilies"}
    total = projects.agg(F.array_sort(F.collect_set("project")).alias("projects"))  # a row for each project
    for n, word in words.items():
        total = total.crossJoin(found[n].agg(F.count("*").alias(word)))  # one row on either side
    out["summary"] = total.select(*words.values(), "projects")
    return out


def write(made: dict[str, DataFrame], folder: str) -> None:
    for name, table in made.items():
        write_json(table, f"{folder}/{name}")
