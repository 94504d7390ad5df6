"""Mixing sources to target weights, with DataFrame functions only.

Words are aggregated by source; a source's target over its size is its
repetition rate.  Each document is emitted floor(rate) times, and once more if a
number hashed from its id, or from its text if it has none, falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common
from tessera.llm.quality import word_list
from tessera.storage import materialize

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all sizes, and the most of one source's size that its target takes.
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Sources up to which their table is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 50_000


def chance(doc_id: str, text: str = "text") -> Column:
    """A number in [0, 1) from the md5 of the seed and the id, or of the text where there is no id; SQL engines agree on it."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(SEED + ":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0, by code point, null last) without bringing all sources into one task."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    parts = materialize(parts.withColumn("place", F.row_number().over(own)), "sources")
    before, sofar = [], 0
    for r in parts.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        before.append((r["part"], sofar))
        sofar += r["count"]
    offsets = sources.sparkSession.createDataFrame(before, "part int, before long")
    return parts.join(F.broadcast(offsets), "part").select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``rate`` from rows (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = materialize(ranked(sources).withColumn("weight", weight), "weights")
    wanted = SHARE * (table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    level, known = 0.0, -1
    while True:  # the level only rises, so capped sources stay capped
        full = F.lit(level) * F.col("weight") >= MOST * F.col("source_size")
        r = table.agg(F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count_if(full).alias("n")).first()
        if r["n"] == known or not r["weights"]:
            break
        known, level = r["n"], (wanted - r["capped"]) / r["weights"]
    target = F.least(F.lit(float(level)) * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    return table.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Joins ``_source``, ``source_size``, ``target``, ``rate`` to rows by column ``_key`` (a struct, so null meets null)."""
    keyed = rates.select(F.struct("source").alias("_key"), "source_size", "target", "rate")
    if rates.count() <= BROADCAST_SOURCES:
        keyed = F.broadcast(keyed)
    return rows.join(keyed, "_key")


def copies() -> Column:
    whole = F.floor("rate")
    return (whole + F.when(F.col("_chance") < F.col("rate") - whole, 1).otherwise(0)).cast("int")


def sizes_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "source", F.size(word_list(F.col("text"))).cast("long").alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, copies repeated, with the columns of ``docs``.

    A null source is a source of its own.  Sources without words have rate 0;
    rows with the same id are taken alike, rows without one by their text.  Null
    and empty texts have no word: their copies add none.  An empty table gives an
    empty result; other columns, whatever their names, stay.
    """
    rates = targets(sizes_of(docs))
    rows = docs.select(F.struct("*").alias("_row"), F.struct("source").alias("_key"), chance("doc_id").alias("_chance"))
    rows = with_rates(rows, rates).withColumn("_copies", copies()).where("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    sizes = materialize(sizes_of(docs.withColumn("_chance", chance("doc_id")), "doc_id", "_chance"), "sizes")
    rows = sizes.select("doc_id", "size", F.struct("source").alias("_key"), "_chance")
    rows = with_rates(rows, targets(sizes))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (copies() * F.col("size")).cast("long").alias("taken"))


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))) AS digest, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes GROUP BY source),
ordered AS (  -- sources reach their caps in the order of size over weight
  SELECT *, 2.0 * source_size / weight AS cap_level,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY 2.0 * source_size / weight DESC, source DESC NULLS FIRST) AS weights
  FROM sources),
levels AS (
  SELECT *, ((1.5 * (SELECT sum(source_size) FROM sources) - capped) / weights)::DOUBLE AS level FROM ordered),
chosen AS (SELECT max(level) FILTER (WHERE level < cap_level) AS level FROM levels),
targets AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM chosen), 0) * weight, (2 * source_size)::DOUBLE) AS target FROM sources)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(digest, 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT s.doc_id, s.size, s.digest, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""
