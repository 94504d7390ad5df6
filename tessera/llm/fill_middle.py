"""Fill-in-middle transformation of texts, their lines found by bit-parallel operations on big integers.

A text's bytes are translated to a class mask, one bit for each byte, that
stands in one integer.  Shifting and combining masks marks where units begin;
the number of bits is the number of units, and the k-th of them is selected by
halving the mask until one bit is left.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SEED = "7"
#: Percent of texts that are transformed, and percent of these that take the form with the suffix first.
RATE, SPM = 100, 50
# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
NEWLINES = bytes(ord("1") if c == ord("\n") else ord("0") for c in range(256))
#: Bytes that continue a character of UTF-8.
CONTINUED = bytes(ord("1") if c & 0xC0 == 0x80 else ord("0") for c in range(256))


def mask(data: bytes, classes: bytes) -> int:
    """An integer whose i-th bit tells whether the i-th byte is of the class that ``classes`` maps to 1."""
    return int(data[::-1].translate(classes), 2) if data else 0


def unit_starts(data: bytes) -> int:
    """Bits where lines begin: at the first byte, and after each line break but the last byte's."""
    return (mask(data, NEWLINES) << 1 | 1) & ((1 << len(data)) - 1)


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it, by halving the ``width`` bits."""
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def characters(data: bytes) -> int:
    """Code points: bytes less those that continue a character."""
    return len(data) - mask(data, CONTINUED).bit_count()


def chosen(doc_id, seed: str) -> list[int]:
    """Four numbers from the digest of the seed and the id; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(data: bytes, draws: list[int], rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle (None if plain), output."""
    starts = unit_starts(data)
    n = starts.bit_count()
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or draws[2] % 100 >= rate:
        return n, "plain", None, None, data
    a, b = (select(starts, k, len(data)) if k < n else len(data) for k in sorted(x % (n + 1) for x in draws[:2]))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if draws[3] % 100 < spm:
        form, out = "spm", b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    else:
        form, out = "psm", b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return n, form, characters(prefix), characters(middle), out


def restored(output: bytes, form: str) -> bytes:
    """The text that ``transformed`` made ``output`` from; a text with a mark of its own is never but plain."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, tail = output.removeprefix(first).partition(second)
    tail, _, middle = tail.partition(MIDDLE)
    return tail + middle + head if form == "spm" else head + middle + tail


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``, and ``restored``, rebuilt from output and form.

    Null and empty texts have no unit and are plain.  Texts of any length are cut
    whole, with work in proportion to it.  Rows with one id and text give one
    result; a null id draws as the empty text.  An empty table gives an empty
    result; further columns, whatever their names, are ignored.
    """

    def run(batches):
        for b in batches:
            out = [transformed(t, chosen(i, seed), rate, spm) for i, t in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1)), strict=True)]
            n, form, prefix, middle, texts = zip(*out, strict=True) if out else ([],) * 5
            back = [restored(x, f) for x, f in zip(texts, form, strict=True)]
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (texts, back))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return common.map_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
ends AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM ends)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
