"""What the text operators share: inputs, splits of rows, Arrow batches, character classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words: a word is a run of anything else.
WORD_SPACE = "\x20\t\n\x0b\x0c\r"
#: The same as a class of Java's regular expressions.
WORD_SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows and bytes that an Arrow batch holds at most, so that long texts keep a worker's memory bounded.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_LIMITS.

    Spark has these limits for a session only.  They are set where the session
    has no setting of its own, when the first such operator is planned.
    """
    conf = df.sparkSession.conf
    for key, limit in BATCH_LIMITS.items():
        if conf.get(key, None) is None:
            conf.set(key, limit)
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def categories() -> np.ndarray:
    """The first letter of each code point's general category, as its ASCII code."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), dtype=np.uint8)


def sampled(rows: DataFrame, stratum: str, key: str, cap: int, seed: int) -> DataFrame:
    """About ``cap`` rows of each stratum, chosen by a hash of the key, with column ``share``: the part that was taken.

    The bound holds in expectation for any number of rows; a stratum below the
    cap is taken whole.
    """
    counts = rows.groupBy(stratum).count().collect()
    if not counts:
        return rows.withColumn("share", F.lit(1.0))
    share = F.lit(1.0)
    for r in counts:
        share = F.when(F.col(stratum) == F.lit(r[stratum]), F.lit(min(1.0, cap / r["count"]))).otherwise(share)
    return rows.withColumn("share", share).where(uniform(F.col(key), seed) < F.col("share"))
