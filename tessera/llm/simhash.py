"""Near-duplicate search on SimHash fingerprints with pivot distance tables.

Fingerprints at ``radius`` or fewer differing bits are linked.  Cut into
``radius + k`` blocks, two linked fingerprints agree on k blocks at least, so
every link lies in some bucket of equal blocks.  Inside a bucket a pair is first
compared by its rows of the pivot table: Hamming distances to fixed reference
fingerprints, whose largest difference cannot exceed the pair's own distance.
Only survivors are verified bit by bit.  A task does both for whole buckets and
returns one edge for each fingerprint that they connect to an earlier one, so no
pair is ever a row and rows grow with the members of a bucket, not their pairs.

A bucket of more than ``HOT_BUCKET`` fingerprints is not paired: two
fingerprints within 4 bits are both within 2 bits of some common point, so each
one sends the points around it and the fingerprints that meet at a point form a
star.  That is exact and linear in the bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common
from tessera.operators.graph import connected_components
from tessera.storage import discard, materialize

SEED = 42
SHINGLE = 4
RADIUS = 4
HOT_BUCKET = 512
#: Fingerprints that a bucket of random fingerprints holds on average, at most; more and the blocks get finer.
BUCKET_MEAN = 64
#: Pairs that a task compares at once, about; a bucket is compared whole.
PAIRS = 1 << 20
#: Removed ids that are broadcast at most: 16 MB as longs.
BROADCAST_IDS = 1_000_000
#: Distances of seven pivots lie in one long, a byte each.
LANES = 7
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(2 * LANES)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(data: bytes, size: int) -> int:
    """The fingerprint of a UTF-8 text as a signed long; 0 without a word."""
    words = data.lower().split()  # of bytes: lowers A-Z and splits at the white space of WORD_SPACE only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n], ends[size - 1 :] if len(words) >= size else ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` for each row; null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint_of(x, size) for x in common.as_bytes(b.column(1))], pa.int64())], ["doc_id", "fp"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def masks(blocks: int, agree: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def pivot_table(fps: np.ndarray) -> list[np.ndarray]:
    """The pivot table's rows of fingerprints: their distances to the pivots, LANES of them in each of two longs."""
    away = [np.bitwise_count(fps ^ np.uint64(p)).astype(np.int64) for p in PIVOTS]
    return [sum(x << 8 * i for i, x in enumerate(away[at : at + LANES])) for at in (0, LANES)]


def verified(fps: np.ndarray, table: list[np.ndarray], a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs have no distance to a pivot that differs by more than ``radius``, and no more bits that differ than that."""
    high, most = sum(0x80 << 8 * i for i in range(LANES)), sum(radius << 8 * i for i in range(LANES))
    same = np.arange(len(a))
    for t in table:
        for x, y in ((a, b), (b, a)):  # in each byte, y - x <= radius: the high bit is not borrowed from
            same = same[((t[x[same]] | high) - t[y[same]] + most) & high == high]
    return same[np.bitwise_count(fps[a[same]] ^ fps[b[same]]) <= radius]


def bucket_stars(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges that connect in each bucket what its links connect: from the first of what is connected to each other one.

    ``fps`` are the fingerprints of one bucket after the other.
    """
    place = np.arange(len(fps))
    later = np.repeat(np.cumsum(sizes), sizes) - place - 1
    a = np.repeat(place, later)
    b = np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later) + a + 1
    near = verified(fps, pivot_table(fps), a, b, radius)
    a, b, label = a[near], b[near], place
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    ends = np.flatnonzero(label != place)
    return fps[label[ends]], fps[ends]


def bucket_links(keys: DataFrame, radius: int) -> DataFrame:
    """``src``, ``dst``: the stars of each bucket of (cut, bits, fp); fewer rows than the buckets have members."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            step, start, ends = np.cumsum(sizes * sizes) // PAIRS, np.cumsum(sizes) - sizes, np.cumsum(sizes)
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(step)) + 1):
                if len(part):
                    found = bucket_stars(fps[start[part[0]] : ends[part[-1]]], sizes[part], radius)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["src", "dst"])

    buckets = keys.groupBy("cut", "bits").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    return common.map_batches(buckets.select("fps"), run, "src long, dst long")


def links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges ``src``, ``dst`` between distinct fingerprints of column ``fp``.

    They connect exactly what links at ``radius`` or fewer bits connect; inside
    buckets they are stars, not all pairs.
    """
    n = fps.count()
    blocks = radius + 2
    while n / 2 ** (64 * (blocks - radius) / blocks) > BUCKET_MEAN and blocks < 2 * radius + 2:
        blocks += 1
    chosen = masks(blocks, blocks - radius)
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in chosen])).alias("cut", "bits"))
    hot = keys.groupBy("cut", "bits").count().where(F.col("count") > hot_bucket).select("cut", "bits")
    pairs = bucket_links(keys.join(hot, ["cut", "bits"], "left_anti"), radius)

    steps = [(i, signed(sum(1 << k for k in bits))) for i, m in enumerate(chosen) for r in range(radius // 2 + radius % 2 + 1) for bits in combinations([k for k in range(64) if not m >> k & 1], r)] if hot.limit(1).count() else []
    if steps:
        around = fps.sparkSession.createDataFrame(steps, "cut int, step long")  # its size depends on blocks and radius only
        at = keys.join(hot, ["cut", "bits"], "left_semi").join(F.broadcast(around), "cut").select("cut", "bits", "fp", F.col("fp").bitwiseXOR(F.col("step")).alias("point"))
        star = at.withColumn("src", F.min("fp").over(Window.partitionBy("cut", "bits", "point")))  # a point has no more fingerprints than steps
        pairs = pairs.unionByName(star.where(F.col("src") != F.col("fp")).select("src", F.col("fp").alias("dst")))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for each row of ``docs``.

    ``component_id`` is the least doc_id that links lead to.  Equal texts have
    equal fingerprints and are linked; null and empty texts share fingerprint 0.
    A null doc_id is a row like any other, and never a component's id unless all
    ids of the component are null.  An empty table gives an empty result.
    """
    own = materialize(fingerprints(docs, size), "fingerprints")
    groups = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    found = connected_components(materialize(links(groups.select("fp"), radius, hot_bucket), "links"))
    named = materialize(groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    # written before they are joined, so that Spark may split a component that holds much of the table
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    classes = materialize(named.join(least, "component").select("fp", "component_id"), "classes")
    discard(groups, found, named, least)
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def united(one: DataFrame, other: DataFrame) -> DataFrame:
    """``doc_id``, ``component_id`` for each row of ``one``: what the components of both tables connect."""
    ids = ["doc_id", "component_id"]
    found = connected_components(one.select(ids).unionByName(other.select(ids)), *ids)
    return one.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component in ``found`` (by default, of links by fingerprints), each id once; all columns stay.

    Rows with a null id cannot be told apart and stay.  Of rows with one id the
    least text stays, then the least row as JSON.  Up to BROADCAST_IDS removed
    ids are broadcast, so that no text is shuffled; more are joined.  An empty
    table gives an empty result; texts of any length are compared whole.
    """
    known = F.col("doc_id").isNotNull()
    ids = (near_duplicates(docs) if found is None else found).where(known).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"))
    ids = materialize(ids.where("n > 1 OR NOT kept"), "ids")
    out = without(docs, ids.where(~F.col("kept")).select("doc_id"))
    repeated = ids.where("kept AND n > 1").select("doc_id")
    if repeated.limit(1).count():
        row = F.min_by(F.struct("*"), F.struct("text", F.to_json(F.struct("*"))))
        one = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(row.alias("row")).select("row.*")
        out = without(out, repeated).unionByName(one)
    return out


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids``; up to BROADCAST_IDS ids are broadcast, more are joined."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti")


def op2_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
