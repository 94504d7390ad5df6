"""Near duplicates by the Jaccard similarity of their five-word shingles.

Texts at 0.8 differ in about ten bits of a 64-bit SimHash, and pivots discard
hardly any pair at such a radius.  The pivot tables here therefore hold exact
Hamming distances: a text's fingerprint is its whole shingle set, one bit for
each shingle there is, and the reference fingerprints are taken from the corpus.

Pairs meet in buckets of equal min-wise hashes (``BANDS`` bands of ``ROWS``; a
pair at 0.8 meets with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.9999).
Each bucket's leader, the member that meets most others, is its reference: the
distance of each member to it is computed, which is linear and links the members
of a large group to its middle.  Of the pairs that are then still in different
components, those whose distances to the reference differ by more than similar
sets can differ are discarded; by the triangle inequality none of them is
similar.  Survivors are verified on their whole sets.  Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, simhash
from tessera.operators.graph import connected_components
from tessera.storage import discard, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SEED = 5
HASHES = BANDS * ROWS
#: Shingles that are hashed at once.
STEP = 4096
_numbers = np.random.default_rng(SEED)
FACTORS = _numbers.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _numbers.integers(0, 1 << 63, HASHES, dtype=np.uint64)
PLACES = _numbers.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
BAND_FACTORS = _numbers.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
BAND_OFFSETS = _numbers.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; fewer words than a shingle form one, none form none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    keys = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(words))):
        total += mixed(keys[j : j + n] + PLACES[j]) * PLACES[j]
    return np.unique(mixed(total))


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP]
        np.minimum(least, (part[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return mixed((mixed(least).reshape(BANDS, ROWS) * BAND_FACTORS).sum(axis=1, dtype=np.uint64) + BAND_OFFSETS).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` of the shingle set, its ``size``, ``buckets`` for each row."""

    def run(batches):
        for b in batches:
            found = [shingle_set(x) for x in common.as_bytes(b.column(1))]
            columns = [b.column(0), pa.array(map(set_key, found), pa.int64()), pa.array(map(len, found), pa.int32()), pa.array([buckets_of(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "size", "buckets"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, key long, size int, buckets array<long>")


def sets_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``shingles`` for the sets in ``keys``, each once; only those are shuffled."""

    def run(batches):
        for b in batches:
            found = [shingle_set(x) for x in common.as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["key", "shingles"])

    every = common.map_batches(docs.select("text"), run, "key long, shingles array<long>")
    if keys.limit(simhash.BROADCAST_IDS + 1).count() <= simhash.BROADCAST_IDS:
        keys = F.broadcast(keys)
    return every.join(keys, "key", "left_semi").dropDuplicates(["key"])


def most_apart(a: Column, b: Column, similarity: float) -> Column:
    """The greatest Hamming distance of two sets of these sizes that have at least this Jaccard similarity."""
    return (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-9


def distance(a: str, b: str) -> Column:
    """Hamming distance of two sets: the elements that one of them lacks."""
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def references(docs: DataFrame, entries: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pivot table: ``bucket``, ``key`` and ``apart``, the distance of its set to that of the bucket's leader, of the leader itself 0; and the links ``src``, ``dst`` between leaders and members."""
    degree = entries.groupBy("key").agg(F.sum("members").alias("degree"))
    leaders = entries.join(degree, "key").groupBy("bucket").agg(F.max(F.struct("degree", "key")).alias("top")).select("bucket", F.col("top.key").alias("src"))
    met = materialize(entries.select("bucket", "key").join(leaders, "bucket"), "met")
    pairs = materialize(met.where("key <> src").select("src", F.col("key").alias("dst")).distinct(), "pairs")
    nodes = materialize(pairs.select(F.col("src").alias("key")).unionByName(pairs.select(F.col("dst").alias("key"))).distinct(), "nodes")
    sets = materialize(sets_of(docs, nodes), "sets")
    rows = pairs.join(sets.select(F.col("key").alias("src"), F.col("shingles").alias("a")), "src")
    rows = rows.join(sets.select(F.col("key").alias("dst"), F.col("shingles").alias("b")), "dst")
    known = materialize(rows.select("src", F.col("dst").alias("key"), distance("a", "b").alias("apart"), most_apart(F.size("a"), F.size("b"), similarity).alias("most")), "distances")
    table = materialize(met.join(known, ["src", "key"], "left").select("bucket", "key", F.coalesce("apart", F.lit(0)).alias("apart")), "table")
    links = materialize(known.where("apart <= most").select("src", F.col("key").alias("dst")), "links")
    discard(met, pairs, nodes, sets, known)
    return table, links


def may_be_similar(similarity: float, a: str = "a", b: str = "b") -> Column:
    """Rows of one bucket that neither their sizes nor their distances to the reference keep apart."""
    most = most_apart(F.col(f"{a}.size"), F.col(f"{b}.size"), similarity)
    return (F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= most) & (F.abs(F.col(f"{a}.apart") - F.col(f"{b}.apart")) <= most)


def other_links(docs: DataFrame, labelled: DataFrame, similarity: float) -> DataFrame:
    """Links between rows (bucket, key, size, apart, label) of one bucket with different labels.

    All tests stand in the joins' conditions, so pairs that fail are never rows.
    Whole sets go only to rows that meet one of another component which is not
    discarded.
    """
    split = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rows = materialize(labelled.join(split, "bucket", "left_semi"), "open")
    a, b = rows.alias("a"), rows.alias("b")
    left = materialize(a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") != F.col("b.label")) & may_be_similar(similarity), "left_semi"), "open-left")
    nodes = materialize(left.select("key").distinct(), "nodes")
    full = materialize(left.join(sets_of(docs, nodes), "key"), "open-sets")
    a, b = full.alias("a"), full.alias("b")
    near = distance("a.shingles", "b.shingles") <= most_apart(F.col("a.size"), F.col("b.size"), similarity)
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") < F.col("b.label")) & may_be_similar(similarity) & near
    found = materialize(a.join(b, meet).select(F.col("a.key").alias("src"), F.col("b.key").alias("dst")).distinct(), "links")
    discard(rows, left, nodes, full)
    return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``component_id`` for each row of ``docs``.

    Rows with equal shingle sets are linked, those without a word with each
    other; so are rows whose sets have at least ``similarity``.  ``component_id``
    is the least doc_id that links lead to.  A null doc_id is a row like any
    other, and a component's id only where all its ids are null.  An empty table
    gives an empty result.
    """
    own = materialize(sketches(docs), "sketches")
    classes = materialize(own.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("size").alias("size")), "classes")
    entries = own.dropDuplicates(["key"]).select("key", F.explode("buckets").alias("bucket"))
    met = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    entries = materialize(entries.join(met, "bucket").select("bucket", "key", "members"), "entries")

    table, links = references(docs, entries, similarity)
    found = connected_components(links)
    labelled = table.join(classes.select("key", "size"), "key").join(found, F.col("key") == F.col("node"), "left").select("bucket", "key", "size", "apart", F.coalesce("component", "key").alias("label"))
    labelled = materialize(labelled, "labelled")
    more = other_links(docs, labelled, similarity)
    if more.limit(1).count():
        discard(found)
        found = connected_components(links.unionByName(more))
    named = materialize(classes.join(found, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("component", "key").alias("component")), "named")
    # written before they are joined, so that Spark may split a component that holds much of the table
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    ids = materialize(named.join(least, "component").select("key", "component_id"), "ids")
    out = materialize(own.select("doc_id", "key").join(ids, "key").select("doc_id", "component_id"), "near-duplicates")
    discard(own, classes, entries, table, links, labelled, more, named, least, ids, found)
    return out
