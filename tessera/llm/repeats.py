"""Substring dedup: words in long windows that occur twice or more, found behind a count-min prefilter.

A window is ``window`` consecutive words.  Pass one fills a count-min sketch in
each task; the sketches are merged cell by cell.  What is counted for a window
is its anchor, the least hash among the grams of GRAM words inside it: two equal
windows at different places have equal anchors at different places, so the
count of the anchor is never below the count of the window, and there are fewer
anchors than windows by a factor of about seven.  Counters stop at two, for a
window is either estimated repeated or not.

Pass two groups the windows that are estimated repeated, and only these, by 128
bits of their words.  A group of one is a window that the sketch overestimated;
it has one place, which the group carries.  So what passes on is the short list
of false places, not the links of a passage that a third of the documents share.
Pass three takes these places away from the estimate, which leaves exactly the
repeated windows.

The sketch has a fixed number of cells.  On a corpus that fills it, more windows
are estimated repeated and grouped, in the end all of them; none is lost.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.storage import discard, materialize

WINDOW = 35
#: Words of a gram; a window holds ``window - GRAM + 1`` of them.
GRAM = 20
#: Rows of the sketch and the binary logarithm of the cells in each.  The merged sketch has a bit for each cell:
#: 64 MB in all, which the driver collects and broadcasts whatever the input.
ROWS, CELL_BITS = 2, 28
#: Cells of a segment, the unit in which sketches are merged: a place in it fits into 16 bits.
SEGMENT = 1 << 16
#: Anchors that a task gathers before it sends its sketch on, at most: 32 MB.
FLUSH_ANCHORS = 1 << 22
#: Words that a worker remembers the hashes of, at most.
VOCABULARY = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPREAD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


class Hashes(dict):
    """Numbers of words, and 128 bits of hash for each number."""

    def __init__(self):
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.digests += xxhash.xxh3_128_digest(word)
        return number

    def of(self, texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > VOCABULARY:
            self.clear()
            self.digests.clear()
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, size)
        table = np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)
        return table[numbers, 0], table[numbers, 1]


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A polynomial of each ``size`` consecutive hashes modulo 2**64, from sums over spans that double."""
    sums, span, power = hashes, 1, base
    out, taken, factor = np.zeros(max(0, len(hashes) - size + 1), np.uint64), 0, 1
    while taken < size:
        if size & span:
            out += sums[taken : taken + len(out)] * np.uint64(factor)
            taken, factor = taken + span, factor * power % (1 << 64)
        sums = sums[:-span] + sums[span:] * np.uint64(power) if len(sums) > span else sums[:0]
        span, power = 2 * span, power * power % (1 << 64)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(SPREAD[2])
    return x ^ (x >> np.uint64(32))


def extreme(best, values: np.ndarray, size: int) -> np.ndarray:
    """The least or greatest of each ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values, have = best(values[:-step], values[step:]), have + step
    return values


class Batch:
    """The windows of some texts: ``starts`` of those that lie within one text, among the words of all; ``anchors`` for each window and ``chosen``, the anchors by place."""

    def __init__(self, texts: list[bytes], window: int, known: Hashes):
        self.words = [t.split() for t in texts]  # of bytes: splits at the white space of WORD_SPACE only
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        total, gram = int(self.sizes.sum()), min(GRAM, window)
        self.starts, self.anchors, self.chosen, self.text_of = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not len(self.sizes) or self.sizes.max() < window:
            return
        first, second = known.of(self.words, total)
        text_of = np.repeat(np.arange(len(texts)), self.sizes)[: total - window + 1]
        within = np.arange(len(text_of)) + window <= self.ends[text_of]
        self.starts, self.text_of = np.flatnonzero(within), text_of[within]
        self._hashes, self._window = (first, second), window
        grams = mixed(rolling(first, gram, BASES[0]))
        per = window - gram + 1
        least = extreme(np.minimum, grams, per)
        self.anchors = least[within]
        reached = extreme(np.maximum, np.pad(np.where(within, least, np.uint64(0)), per - 1), per)  # the greatest anchor of the windows around each gram
        self.chosen = grams[reached == grams]

    def of_text(self, i: int) -> slice:
        """Where the windows of the i-th text are among ``starts``."""
        return slice(*np.searchsorted(self.starts, [self.ends[i] - self.sizes[i], self.ends[i]]))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window."""
        if not len(self.starts):
            return self.anchors, self.anchors
        return tuple(rolling(h, self._window, b)[self.starts] for h, b in zip(self._hashes, BASES, strict=True))


def cells(anchors: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return (anchors * np.uint64(SPREAD[row])) >> np.uint64(64 - cell_bits)


def sketch_rows(anchors: np.ndarray, rows: int, cell_bits: int):
    """A task's sketch as (segment, places counted once, places counted more often)."""
    for row in range(rows):
        found, n = np.unique(cells(anchors, row, cell_bits), return_counts=True)
        found += np.uint64(row << cell_bits)
        segment, place = (found // np.uint64(SEGMENT)).astype(np.int64), (found % np.uint64(SEGMENT)).astype("<u2")
        edges = np.flatnonzero(np.diff(segment, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(segment)], strict=True):
            once = n[a:b] == 1
            yield int(segment[a]), place[a:b][once].tobytes(), place[a:b][~once].tobytes()


def sketch(docs: DataFrame, window: int = WINDOW, rows: int = ROWS, cell_bits: int = CELL_BITS) -> np.ndarray:
    """The merged sketch: a bit for each cell, set where the count is two or more."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def count(batches):
        known, held, size = Hashes(), [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append(Batch(common.as_bytes(b.column(0)), window, known).chosen)
                size += len(held[-1])
            if size and (b is None or size >= FLUSH_ANCHORS):
                columns = list(zip(*sketch_rows(np.concatenate(held), rows, cell_bits), strict=True))
                table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
                yield from table.to_batches(max_chunksize=1024)
                held, size = [], 0

    def merge(batches):
        now, counts = None, np.zeros(SEGMENT, np.uint8)

        def full():
            if (counts >= 2).any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()])], ["segment", "bits"])

        for b in batches:
            for segment, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if segment != now:
                    yield from full()
                    now, counts[:] = segment, 0
                once = np.frombuffer(once, "<u2")
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[np.frombuffer(more, "<u2")] = 2
        yield from full()

    parts = common.map_batches(docs.select("text"), count, "segment int, once binary, more binary")
    merged = common.map_batches(parts.repartition("segment").sortWithinPartitions("segment"), merge, "segment int, bits binary").toArrow()
    bits = np.zeros(max(rows << cell_bits, SEGMENT) // 8, np.uint8).reshape(-1, SEGMENT // 8)
    for b in merged.to_batches():
        for segment, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            bits[segment] = np.frombuffer(part.as_buffer(), np.uint8)
    return bits.reshape(-1)


def estimated(anchors: np.ndarray, bits: np.ndarray, rows: int, cell_bits: int) -> np.ndarray:
    """Whether the least counter of an anchor is two or more."""
    out = np.ones(len(anchors), bool)
    for row in range(rows):
        c = cells(anchors, row, cell_bits) + np.uint64(row << cell_bits)
        out &= (bits[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def candidates(docs: DataFrame, bits, window: int, rows: int, cell_bits: int) -> DataFrame:
    """``h1``, ``h2``, ``n``, ``key``, ``place``: windows that are estimated repeated, with the key of their text and their first word's number.

    Of equal texts, a task sends the windows of two: these show that they repeat.
    """
    names = ["h1", "h2", "n", "key", "place"]

    def run(batches):
        known, met = Hashes(), {}
        for b in batches:
            texts, keys = common.as_bytes(b.column(0)), b.column(1).to_numpy()
            fresh = []
            for i, (key, text) in enumerate(zip(keys.tolist(), texts, strict=True)):
                met[key, len(text)] = n = met.get((key, len(text)), 0) + 1
                if n <= 2:
                    fresh.append(i)
            batch = Batch([texts[i] for i in fresh], window, known)
            hit = np.flatnonzero(estimated(batch.anchors, bits.value, rows, cell_bits))
            if len(hit):
                h1, h2 = batch.digests()
                text_of = batch.text_of[hit]
                place = batch.starts[hit] - (batch.ends - batch.sizes)[text_of]
                columns = [h1[hit].view(np.int64), h2[hit].view(np.int64), np.ones(len(hit), np.int64), keys[np.array(fresh)[text_of]], place]
                yield from pa.Table.from_arrays([pa.array(c) for c in columns], names).to_batches(max_chunksize=1 << 16)

    return common.map_batches(docs.select("text", key_of_text()), run, "h1 long, h2 long, n long, key long, place long")


def key_of_text():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")


def without_repeats(docs: DataFrame, window: int = WINDOW, rows: int = ROWS, cell_bits: int = CELL_BITS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept``: each text without the words of windows that also start elsewhere, its other words joined by one space.

    Windows are compared in the input, within one text as well as between texts.
    Null, empty and short texts have no window and keep all words.  Repeated rows
    are texts of their own: each loses what the others have too.  Texts of any
    length are read whole.  A null doc_id is a row like any other; further
    columns, whatever their names, are ignored.  An empty table gives an empty
    result.  ``docs`` is read three times, so it should be a table.
    """
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, window, rows, cell_bits))
    groups = candidates(docs, bits, window, rows, cell_bits).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("place").alias("place"))
    alone = groups.where("n = 1").groupBy("key").agg(F.collect_list(F.struct("place", "h1")).alias("alone"))  # all of one text
    alone = materialize(alone, "single-windows")
    texts = docs.select("doc_id", "text", key_of_text()).join(alone, "key", "left").select("doc_id", "text", F.col("alone.place").alias("place"), F.col("alone.h1").alias("h1"))

    def run(batches):
        known = Hashes()
        for b in batches:
            batch = Batch(common.as_bytes(b.column(1)), window, known)
            again = estimated(batch.anchors, bits.value, rows, cell_bits)
            h1 = batch.digests()[0].view(np.int64)
            sizes, removed, kept = [], [], []
            for i, words in enumerate(batch.words):
                own = batch.of_text(i)
                rest = again[own].copy()
                if b.column(2)[i].is_valid:
                    place, hashes = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy()
                    fits = place < len(rest)
                    place, hashes = place[fits], hashes[fits]
                    rest[place[h1[own][place] == hashes]] = False  # a text with the same key but other words is not touched
                at = np.flatnonzero(rest)
                edges = np.zeros(len(words) + 1, np.int64)
                edges[at] += 1
                edges[at + window] -= 1  # places differ, so no index repeats
                inside = np.cumsum(edges)[:-1] > 0
                sizes.append(len(words))
                removed.append(int(inside.sum()))
                kept.append(b" ".join(words if not len(at) else [words[k] for k in np.flatnonzero(~inside)]))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return common.map_batches(texts, run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def op11_repeated_windows(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
hashed AS (SELECT r, list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: md5(array_to_string(words[i:i + {WINDOW - 1}], ' '))) AS h FROM d WHERE len(words) >= {WINDOW}),
windows AS (SELECT r, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i FROM hashed),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM windows WHERE h IN (SELECT h FROM repeated)),
places AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
