"""Media columns: PNG files in binary columns, written and read with zlib and numpy.

A file is signature, IHDR, IDAT and IEND chunks, each with a checksum that
reading tests.  Scan lines of 8-bit grey samples take the filter that suits each
of them, and are unfiltered with numpy, all files of an Arrow batch together; the
feature is a hash of low-frequency cosine coefficients.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 6
#: Side of the image that the cosine transform sees, and of the low-frequency corner that is hashed.
SIDE, CORNER = 32, 8
#: Most bytes that one IDAT chunk holds.
CHUNK = 1 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def predictions(pixels: np.ndarray) -> np.ndarray:
    """What each of the five filters (none, sub, up, average, Paeth) predicts for each sample, as int16."""
    x = np.zeros((len(pixels) + 1, pixels.shape[1] + 1), np.int16)
    x[1:, 1:] = pixels
    left, above, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    return np.stack([np.zeros_like(left), left, above, (left + above) >> 1, paeth(left, above, corner)])


def paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearest to left + above - corner; left wins ties, then above."""
    to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    return np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))


def filtered(pixels: np.ndarray) -> np.ndarray:
    """Scan lines with their filter byte; each line takes the filter whose differences, read as signed bytes, are least in sum."""
    rest = (pixels - predictions(pixels)).astype(np.uint8)
    kinds = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return np.hstack([kinds.astype(np.uint8)[:, None], rest[kinds, np.arange(len(pixels))]])


def write_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey image as a PNG file, a filter chosen for each line."""
    height, width = pixels.shape
    packed = zlib.compress(filtered(pixels).tobytes(), LEVEL)
    body = b"".join(chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + chunk(b"IEND", b"")


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of images of one width, given as scan lines whose first byte names the filter; one byte a pixel.

    A sample needs its left neighbour and, by its line's filter, the line above.
    So lines are numbered from the last one that needs none above, and all
    samples with the same sum of that number and their column, of all images,
    are computed at once.
    """
    if not images:
        return []
    width, sizes = images[0].shape[1] - 1, [len(x) + 1 for x in images]
    ends = np.cumsum(sizes)
    lines = np.zeros((int(ends[-1]), width + 1), np.uint8)  # a line of zeros stands above each image
    for x, end in zip(images, ends.tolist(), strict=True):
        lines[end - len(x) : end] = x
    kinds = lines[:, 0]
    place = np.arange(len(lines))
    depth = place - np.maximum.accumulate(np.where(kinds < 2, place, 0))
    out = np.zeros((len(lines), width + 1), np.int16)  # and a column of zeros to the left of each
    flat, given = out.ravel(), lines.astype(np.int16).ravel()
    order = np.argsort(depth, kind="stable")
    depth = depth[order]
    base, kinds = order * (width + 1), kinds[order]
    for step in range(int(depth[-1]) + width):
        a, b = np.searchsorted(depth, [step - width + 1, step + 1])
        at, kind = base[a:b] + (step - depth[a:b]) + 1, kinds[a:b]
        left, up = flat[at - 1], at - (width + 1)
        above, corner = flat[up], flat[up - 1]  # of the first line they are read from the end, and not used
        guess = np.choose(kind, [np.int16(0), left, above, (left + above) >> 1, paeth(left, above, corner)])
        flat[at] = (given[at] + guess) & 0xFF
    pixels = out[:, 1:].astype(np.uint8)
    return [pixels[end - len(x) : end] for x, end in zip(images, ends.tolist(), strict=True)]


def read_lines(data: bytes) -> np.ndarray:
    """The scan lines of an 8-bit grey PNG file without interlacing; ValueError for a broken file."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is cut short or its checksum differs")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("a header of another size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
        raise ValueError("not a whole 8-bit grey image")
    whole, reader = head[1] * (head[0] + 1), zlib.decompressobj()
    try:
        lines = reader.decompress(b"".join(packed), whole + 1)  # no more than the header names
    except zlib.error as e:
        raise ValueError("the samples cannot be inflated") from e
    if len(lines) != whole or not reader.eof:
        raise ValueError("another number of samples than the header names, or no end")
    found = np.frombuffer(lines, np.uint8).reshape(head[1], head[0] + 1)
    if found[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return found


def read_pngs(files: list[bytes | None]) -> list[np.ndarray | None]:
    """The samples of each file; None for a null or broken one.  Images of one width are unfiltered together."""
    widths: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, data in enumerate(files):
        try:
            lines = read_lines(data) if data is not None else None
        except ValueError:
            lines = None
        if lines is not None:
            widths.setdefault(lines.shape[1], []).append((i, lines))
    out: list[np.ndarray | None] = [None] * len(files)
    for same in widths.values():
        for (i, _), pixels in zip(same, unfilter([x for _, x in same]), strict=True):
            out[i] = pixels
    return out


@cache
def cosines() -> np.ndarray:
    k, x = np.arange(CORNER)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def shrink(values: np.ndarray, size: int) -> np.ndarray:
    """Means over ``size`` nearly equal spans of the first axis; spans of a short axis repeat its rows."""
    n = len(values)
    starts = np.arange(size) * n // size
    ends = np.maximum(starts + 1, (np.arange(size) + 1) * n // size)
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (total[ends] - total[starts]) / (ends - starts)[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits: which low-frequency coefficients exceed their median."""
    small = shrink(shrink(pixels, SIDE).T, SIDE).T
    low = (cosines() @ small @ cosines().T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: each text's UTF-8 bytes, padded with zeros, as a PNG.

    Null counts as empty: one line of zeros.  Repeated rows give equal files, an
    empty table an empty result; a text of any length is one file, whose memory
    is a small multiple of the text's.  Other columns are ignored.
    """

    def run(batches):
        for b in batches:
            texts = common.as_bytes(b.column(1))
            files = []
            for x in texts:
                rows = max(1, -(-len(x) // WIDTH))
                files.append(write_png(np.frombuffer(x.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Digests of each file and of the samples read back from it; all null where the file is null; only the file's where it is broken."""
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def features(data: bytes | None, pixels: np.ndarray | None) -> tuple:
        if data is None:
            return (None,) * 6
        if pixels is None:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)

    def run(batches):
        for b in batches:
            files = b.column(2).to_pylist()
            found = list(zip(*map(features, files, read_pngs(files)), strict=True)) or [()] * 6
            columns = [pa.array(x, pa.int64() if kind == "long" else pa.string()) for x, kind in zip(found, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "n_bytes", *kinds])

    return common.map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


def op6_png_media(spark, sf_dir: str) -> DataFrame:
    return decode_media(encode_media(common.read(spark, sf_dir, "documents")))
