"""Periodic runs of words by bit-parallel lags.

The numbers of a text's words are cut into bit planes, one big integer for each
binary digit.  XOR of a plane with itself shifted by q marks the places whose
word differs in that digit from the word q places on; OR over the planes leaves
zeros exactly where the words are equal.  Ands with shifts that double keep the
places where enough zeros follow.  A run of period q is such a stretch of zeros
and q words more.

Only lags that can have a run are compared.  With Q the greatest power of two up
to q, the zeros of a run cover three multiples of Q in a row at least; comparing
the words at all multiples of Q with those q on, for all q of one Q at once, is
linear in the text and leaves out no lag that has a run.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.quality import word_list

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def planes(ids: np.ndarray, distinct: int) -> list[int]:
    """A big integer for each binary digit of the numbers; bit i is that of the i-th word."""
    return [int.from_bytes(np.packbits(ids >> b & 1, bitorder="little").tobytes(), "little") for b in range((distinct - 1).bit_length())]


def possible_lags(ids: np.ndarray) -> list[int]:
    """Lags q up to a quarter of the text where the words at three multiples of Q in a row equal those q on."""
    n, out, q = len(ids), [], 1
    while LEAST_PERIODS * q <= n:
        rows = (n - q) // q  # blocks of Q words that begin Q on
        last = ids[rows * q + q :]
        equal = ids[q : (rows + 1) * q].reshape(rows, q) == ids[: rows * q : q, None]
        three = (equal[:-2] & equal[1:-1] & equal[2:]).any(axis=0)
        if rows >= 2 and len(last):  # the last block is not whole
            three[: len(last)] |= equal[-2, : len(last)] & equal[-1, : len(last)] & (last == ids[rows * q])
        out += [x for x in (q + np.flatnonzero(three)).tolist() if LEAST_PERIODS * x <= n]
        q *= 2
    return out


def followed(zeros: int, need: int) -> int:
    """Places where ``need`` set bits follow, by ands with shifts that double."""
    have = 1
    while have < need and zeros:
        step = min(have, need - have)
        zeros &= zeros >> step
        have += step
    return zeros


def stretches(zeros: int, need: int) -> list[tuple[int, int]]:
    """Start and length of the maximal stretches of ``need`` set bits or more."""
    begun, out, at = followed(zeros, need), [], 0
    while begun:
        skip = (begun & -begun).bit_length() - 1  # to the next stretch
        begun >>= skip
        at += skip
        more = (~begun & (begun + 1)).bit_length() - 1  # places in a row
        out.append((at, more + need - 1))
        begun >>= more
        at += more
    return out


def runs_of(ids: np.ndarray, distinct: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period, from the numbers of the words."""
    n, digits, found = len(ids), None, {}
    for q in possible_lags(ids):
        digits = planes(ids, distinct) if digits is None else digits
        differ, every = 0, (1 << (n - q)) - 1
        zeros = every
        for p in digits:
            differ |= p ^ p >> q
            zeros = ~differ & every
            if not zeros:
                break
        for start, equal in stretches(zeros, max(LEAST_WORDS, LEAST_PERIODS * q) - q):
            end = start + equal + q
            # a stretch that has a smaller period lies within the run of that period, which divides q
            if not any(q % p == 0 and within(start, end, *at) for p, at in found.items()):
                starts, ends = found.setdefault(q, ([], []))
                starts.append(start)
                ends.append(end)
    return sorted(((s, e - s, q) for q, at in found.items() for s, e in zip(*at, strict=True)), key=lambda r: (r[0], r[2]))


def within(start: int, end: int, starts: list[int], ends: list[int]) -> bool:
    """Whether one of the runs of a period, which are in order of their starts and so of their ends, holds all of a stretch."""
    k = bisect_right(starts, start) - 1
    return k >= 0 and end <= ends[k]


def numbered(words: list[bytes]) -> tuple[np.ndarray, int]:
    known = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    return ids, len(known)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed``: the words outside all repeats, joined by one space.

    A run is a stretch of words with smallest period q and LEAST_WORDS and
    LEAST_PERIODS * q words at least, that no word beside it extends; all but its
    first q words are dropped.  Null, empty and short texts have no run.  Texts of
    any length are read whole.  Repeated rows are judged alike; a null id is a row
    like any other.  An empty table gives an empty result; further columns,
    whatever their names, are ignored.
    """
    schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            sizes, runs, kept = [], [], []
            for text in common.as_bytes(b.column(1)):
                words = text.split()  # of bytes: splits at the white space of WORD_SPACE only
                found = runs_of(*numbered(words))
                sizes.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                if found:
                    drop = np.zeros(len(words), bool)
                    for s, m, q in found:
                        drop[s + q : s + m] = True
                    words = [words[i] for i in np.flatnonzero(~drop)]
                kept.append(b" ".join(words))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, schema), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return common.map_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``; of one id in ten the text's words, from some word on only the first p of them in turn."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, word_list(F.col("text"))))
    n, g = F.greatest(F.size("words"), F.lit(1)), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", g % n).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8)))
    turned = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.coalesce(F.array_join(turned, " "), "text").alias("text"))


def greatest(runs: Column) -> Column:
    """The run of greatest length over period, compared as fractions; the first of equal ones."""
    return F.reduce(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = periodic_runs(planted(docs)).withColumn("best", greatest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS original,
    list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT) AS id_bytes FROM documents),
h AS (
  SELECT *, len(original) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], id_bytes), lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS h FROM d),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS g8 FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM g),
texts AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN original ELSE list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN original[a + (i - a) % p + 1] ELSE original[i + 1] END) END AS words FROM p),
places AS (SELECT r, n, unnest(words) AS w, unnest(range(0, n)) AS i FROM texts),
equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
found AS (SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found s WHERE s.r = f.r AND s.period < f.period AND f.period % s.period = 0 AND s.start <= f.start AND f.start + f.length <= s.start + s.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM places ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN best ON best.r = texts.r LEFT JOIN listed ON listed.r = texts.r LEFT JOIN kept ON kept.r = texts.r
"""
