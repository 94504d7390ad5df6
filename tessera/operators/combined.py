"""One virtual project of what several projects keep, rebuilt where its sources have drifted, and run through all stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedup
from tessera.operators.embedding_sets import key_of
from tessera.operators.funnel import Result, run_pipeline
from tessera.streaming.upsert import exists

BATCH = "combined"
LOG = "source string, fingerprint string, reports long, built_at string, part string"
#: What is copied of each source, and the columns that the stages need.
TABLES = {"inventory": ["name"], "telemetry": ["execs", "last", "tier"], "features": ["m", "t", "f"], "statements": ["sql"], "hashes": ["hashes"]}


def combined_id(project: str = "project", report_id: str = "report_id"):
    """An id that no two projects share; the source's name may hold a colon, for its length is known from the copy's own column."""
    return F.concat(F.col(project), F.lit(":"), F.col(report_id).cast("string"))


@dataclass
class Combined:
    """Tables below ``path``, one partition for each source.  Sources are a few names of configuration."""

    spark: SparkSession
    path: str

    def log(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def drifted(self, final: DataFrame) -> DataFrame:
        """``source``, ``before``, ``now``: sources whose kept reports (project, report_id) are not those of the last build; null where it was not there, or is no more."""
        now = dedup.drift(final, "project").select(F.col("project").alias("source"), F.col("fingerprint").alias("now"))
        before = self.log().select("source", F.col("fingerprint").alias("before"))
        both = before.join(now, "source", "full")
        return both.where(~F.col("before").eqNullSafe(F.col("now"))).select("source", "before", "now")

    def rebuild(self, final: DataFrame, tables: dict[str, DataFrame], now: str) -> list[str]:
        """Copy the rows of the sources that drifted, and drop sources that keep nothing; the names of both.

        Tables are those of TABLES with ``project`` and ``report_id``; statements
        and hashes may be left out.  Other sources' copies are not touched, and a
        build that is run again after it broke off does the rest.
        """
        changed = {r["source"]: r["now"] for r in self.drifted(final).collect()}
        fresh = [s for s, found in changed.items() if found]
        for s in set(changed) - set(fresh):
            self._drop(s)
        if not fresh:
            return sorted(changed)
        kept = final.where(F.col("project").isin(fresh)).select("project", "report_id").distinct()
        part = F.create_map(*[F.lit(x) for s in fresh for x in (s, key_of(s))])[F.col("source")]
        for name, columns in TABLES.items():
            if name not in tables:
                continue
            rows = tables[name].join(kept, ["project", "report_id"], "left_semi")
            rows = rows.select(combined_id().alias("report_id"), F.col("project").alias("source"), F.col("report_id").cast("string").alias("source_id"), *columns).withColumn("part", part)
            for s in fresh:  # a source without rows of this kind leaves no old ones behind
                self._remove(f"{name}/part={key_of(s)}")
            self._write(rows, name)
        counts = kept.groupBy(F.col("project").alias("source")).agg(F.count("*").alias("reports")).join(dedup.drift(kept, "project").withColumnRenamed("project", "source"), "source")
        self._write(counts.select("source", "fingerprint", "reports", F.lit(now).alias("built_at")).withColumn("part", part), "log")
        return sorted(changed)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{table}")

    def _remove(self, place: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _drop(self, source: str) -> None:
        for name in (*TABLES, "log"):
            self._remove(f"{name}/part={key_of(source)}")

    def table(self, name: str) -> DataFrame | None:
        """A copied table, or none if no source has it."""
        return self.spark.read.parquet(f"{self.path}/{name}").drop("part") if exists(self.spark, f"{self.path}/{name}") else None

    def run(self, mode: str = "reference") -> Result:
        """All stages over the combined project."""
        found = {n: self.table(n) for n in TABLES}
        if found["inventory"] is None:
            raise ValueError("nothing is built yet")
        inventory = found["inventory"].select("report_id", F.lit(BATCH).alias("batch"), "name")
        rest = {n: t.select("report_id", *TABLES[n]) if t is not None else None for n, t in found.items()}
        return run_pipeline(inventory, rest["features"], rest["telemetry"], rest["statements"], rest["hashes"], {BATCH: 0}, mode)

    def with_source(self, rows: DataFrame) -> DataFrame:
        """Rows (report_id, ...) of a run with ``source`` and ``source_id``, which the stages do not carry."""
        return rows.join(self.table("inventory").select("report_id", "source", "source_id").distinct(), "report_id")
