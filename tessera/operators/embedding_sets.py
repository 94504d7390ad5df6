"""Named sets of embedded texts: which reports, from what scope and fields, by which model.

A set has one row of what it is made from and a row for each member.  Both tables
are partitioned by the set's key and written by dynamic overwrite, so refreshing
or deleting one set leaves the others alone.  Vectors stay in the shared cache.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.vectors import keyed
from tessera.streaming.upsert import exists

ABOUT = "name string, project string, scope string, source_filter string, model string, dim int, fields string, report_count long, token_estimate long, created_at string, refreshed_at string, version int, key string"
#: Characters that count as one token.
TOKEN_CHARS = 4


def key_of(name: str) -> str:
    """A name as part of a path, whatever characters it has."""
    return hashlib.sha256(name.encode()).hexdigest()[:32]


@dataclass
class EmbeddingSets:
    spark: SparkSession
    path: str

    def _about(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/sets"):
            return self.spark.createDataFrame([], ABOUT)
        return self.spark.read.schema(ABOUT).parquet(f"{self.path}/sets")

    def list(self, project: str | None = None) -> DataFrame:
        """The sets, of one project if it is given, the last refreshed first."""
        rows = self._about().drop("key")
        rows = rows.where(F.col("project") == project) if project else rows
        return rows.orderBy(F.desc("refreshed_at"), F.desc("created_at"), "name")

    def fetch(self, name: str) -> dict | None:
        row = self._about().where(F.col("key") == key_of(name)).first()
        return None if row is None else {**row.asDict(), "fields": json.loads(row["fields"] or "{}")}

    def members(self, name: str) -> DataFrame:
        """``report_id``, ``content_hash`` of a set."""
        kind = "report_id string, content_hash string, key string"
        if not exists(self.spark, f"{self.path}/members"):
            return self.spark.createDataFrame([], kind).drop("key")
        return self.spark.read.schema(kind).parquet(f"{self.path}/members").where(F.col("key") == key_of(name)).drop("key")

    def save(self, config: dict, texts: DataFrame, now: str) -> dict:
        """Create the set that ``config`` names from texts (report_id, text), or refresh it; a refreshed one keeps the time it was created at.

        Members are the texts' hashes for the set's model and dimension.  Empty
        texts are no members; a set without members is not saved.
        """
        name = (config.get("name") or "").strip()
        if not name:
            raise ValueError("an embedding set needs a name")
        model, dim = config.get("model") or "terms", int(config.get("dimensions") or 256)
        rows = texts.where(F.coalesce("text", F.lit("")) != "")
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        if not size["n"]:
            raise ValueError("no report of the scope has a text")
        old, key = self.fetch(name), key_of(name)
        members = keyed(rows, model, dim).select(F.col("report_id").cast("string").alias("report_id"), "content_hash", F.lit(key).alias("key")).distinct()
        self._write(members, "members")
        about = {
            "name": name, "project": config.get("project"), "scope": config.get("scope") or "post-family", "source_filter": config.get("sourceFilter") or "all", "model": model, "dim": dim, "fields": json.dumps(config.get("fields") or {}, sort_keys=True),
            "report_count": size["n"], "token_estimate": max(1, size["chars"] // TOKEN_CHARS), "created_at": old["created_at"] if old else now, "refreshed_at": now, "version": old["version"] + 1 if old else 1, "key": key,
        }
        self._write(self.spark.createDataFrame([tuple(about.values())], ABOUT), "sets")
        return self.fetch(name)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{self.path}/{table}")

    def delete(self, name: str) -> bool:
        """Remove a set and its members, not the vectors; whether there was one."""
        found = self.fetch(name) is not None
        for table in ("sets", "members"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/key={key_of(name)}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return found

    def resolve(self, config: dict) -> dict:
        """``config`` with project, scope, filter, fields, model and dimension of the set it names; as it is if it names none that there is."""
        name = (config.get("embeddingSetName") or "").strip()
        found = self.fetch(name) if name else None
        if not found:
            return config
        own = {"project": "project", "scope": "scope", "sourceFilter": "source_filter", "model": "model", "dimensions": "dim", "fields": "fields"}
        return {**config, **{k: found[c] for k, c in own.items()}, "resolvedFrom": name}
