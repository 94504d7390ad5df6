"""A table that a stream merges into by key, once for each batch however often the batch is run.

Keys are dealt into buckets.  A batch writes the buckets that it touches anew, as
versions named by the batch's number, and then a log entry that lists them.  A
batch that is run again reads the versions before its own number only, so it
writes the same versions again; what a run that broke off has left is written
over.  Buckets that a batch does not touch cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``bucket``, ``version``: the latest version of each bucket, a row for each bucket; only of batches below ``before``, if given."""
    log = spark.read.schema("bucket int, version long").parquet(f"{path}/log")
    if before is not None:
        log = log.where(F.col("version") < before)
    return log.groupBy("bucket").agg(F.max("version").alias("version"))


def current(spark: SparkSession, path: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """The merged table as of the last batch, or of the last before a number; empty if there is none."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields]).add("bucket", IntegerType()).add("version", LongType())
    rows = spark.read.schema(stored).parquet(f"{path}/data")
    return rows.join(F.broadcast(versions(spark, path, before)), ["bucket", "version"], "left_semi").drop("bucket", "version")


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], merge: Merge, buckets: int) -> None:
    """Write the versions of one batch: ``merge(old, new)`` of the rows in the buckets that its keys lie in."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.withColumn("bucket", bucket)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    if not touched:
        return
    old = current(spark, path, batch.schema, number).where(bucket.isin(touched))
    rows = merge(old, batch).withColumn("bucket", bucket).withColumn("version", F.lit(number).cast("long"))
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows.repartition("bucket").write.mode("overwrite").options(**dynamic).partitionBy("bucket", "version").parquet(f"{path}/data")
    log = spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1)
    log.write.mode("overwrite").options(**dynamic).partitionBy("version").parquet(f"{path}/log")


def merge_stream(stream: DataFrame, path: str, keys: list[str], merge: Merge, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64, once: bool = True) -> StreamingQuery:
    """Start a stream whose batches, prepared by ``prepare``, are merged into the table at ``path``; with ``once`` it ends when all that is there is read."""

    def run(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        merge_batch(rows, number, path, keys, merge, buckets)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_wins(keys: list[str], order: str) -> Merge:
    """Of one key the row of greatest ``order``; of equal ones the greatest row."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in keys]
        rows = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r"))
        return rows.select(*keys, "r.*").select(*new.columns)

    return merge


def totals(keys: list[str]) -> Merge:
    """The sums of all other columns by key."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in keys]
        return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest]).select(*new.columns)

    return merge
