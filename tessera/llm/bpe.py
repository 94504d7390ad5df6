"""Byte-level BPE with vectorised pre-tokenisation.

Each code point becomes a symbol (its class and, for white space and
apostrophes, what follows it).  A symbol is a function on the states of a small
automaton; the functions that arise are closed under composition and numbered,
so an associative scan over those numbers gives the state before every code
point, and state and symbol tell whether a token starts there.  No regular
expression is run.  The slices then go through a cache of merged pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

# Unicode's White_Space property, which is \s in the tokenizer's pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What follows an apostrophe in the pattern's contractions.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

#: Symbols: letter, number, other; white space before white space or the end; a
#: space, or other white space, before something else; an apostrophe that may
#: start a contraction; the letters after it, the last one and the one before.
LETTER, NUMBER, OTHER, SPACES, PREFIX, LONE, CUT, CUT_END, CUT_MIDDLE = range(9)
#: States: a token must start; inside letters, numbers, others, spaces; after a
#: space that joins what follows; inside a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINING, IN_CUT = range(7)
STATES, SYMBOLS = 7, 9
#: Code points that are scanned at a time.
BLOCK = 1 << 20
#: Pieces that a worker keeps merged; the cache is emptied when it is full.
CACHE_PIECES = 120_000
#: From this length on, pieces are merged with a heap.
LONG_PIECE = 64


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the symbol."""
    if state == IN_CUT and symbol in (CUT_MIDDLE, CUT_END):
        return (IN_CUT if symbol == CUT_MIDDLE else FRESH), False
    if symbol == SPACES:
        return IN_SPACES, state != IN_SPACES
    if symbol == PREFIX:
        return JOINING, True
    if symbol == LONE:
        return FRESH, True
    if symbol == CUT and state not in (IN_OTHERS, JOINING):
        return IN_CUT, True
    kind = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, CUT: IN_OTHERS}.get(symbol, IN_LETTERS)
    return kind, state not in (kind, JOINING)


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function; composition table; state that each function leads to from FRESH; starts by state and symbol."""
    own = [tuple(step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    known = list(dict.fromkeys([tuple(range(STATES)), *own]))
    number = {f: i for i, f in enumerate(known)}
    for f in known:  # grows while it is read
        for g in own:
            if (h := tuple(g[s] for s in f)) not in number:
                number[h] = len(known)
                known.append(h)
    assert len(known) <= 256
    table = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8)
    starts = np.array([[step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)])
    return np.array([number[f] for f in own], np.uint8), table.ravel(), np.array([f[FRESH] for f in known], np.uint8), starts.ravel()


@cache
def classes() -> np.ndarray:
    c = common.categories()
    out = np.full(len(c), OTHER, np.uint8)
    out[c == ord("L")], out[c == ord("N")] = LETTER, NUMBER
    out[WHITE_SPACE] = SPACES
    return out


def scan(items: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Inclusive prefix products under the composition table."""
    if len(items) <= 32:
        out, held = items.copy(), 0
        for i, x in enumerate(items.tolist()):
            out[i] = held = int(table[held * size + x]) if i else x
        return out
    rows = -(-len(items) // 32)
    grid = np.zeros((rows, 32), np.uint8)  # 0 is the identity
    grid.ravel()[: len(items)] = items
    grid = np.ascontiguousarray(grid.T)
    for i in range(1, 32):
        grid[i] = table[grid[i - 1].astype(np.intp) * size + grid[i]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[31], table, size)[:-1]
    return np.ascontiguousarray(table[before.astype(np.intp)[None, :] * size + grid].T).ravel()[: len(items)]


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in an array of code points that is scanned whole."""
    functions, table, reach, starts = automaton()
    symbols = classes()[points]
    space = symbols == SPACES
    last = np.zeros(len(points), bool)
    last[:-1] = space[:-1] & ~space[1:]
    symbols[last] = np.where(points[last] == 0x20, PREFIX, LONE)
    for i in np.flatnonzero(points == 0x27).tolist():
        after = "".join(map(chr, points[i + 1 : i + 3].tolist()))
        if after[:1] and after[0] in SHORT_ENDINGS:
            symbols[i : i + 2] = CUT, CUT_END
        elif after in LONG_ENDINGS:
            symbols[i : i + 3] = CUT, CUT_MIDDLE, CUT_END
    prefix = scan(functions[symbols], table, int(len(reach)))
    state = np.zeros(len(points), np.uint8)
    state[1:] = reach[prefix[:-1]]
    return np.flatnonzero(starts[state.astype(np.intp) * SYMBOLS + symbols])


def blocks(points: np.ndarray) -> list[np.ndarray]:
    """Cuts before spaces that surely start a token: a single space between things that are not white space."""
    out, at = [], 0
    while len(points) - at > BLOCK:
        near = points[at + 1 : at + BLOCK + 1]
        space = classes()[near] == SPACES
        cut = np.flatnonzero((near[1:-1] == 0x20) & ~space[:-2] & ~space[2:])
        if not len(cut):
            break
        out.append(points[at : at + 2 + int(cut[-1])])
        at += 2 + int(cut[-1])
    return [*out, points[at:]]


class Codec:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.packed = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        self.pieces: dict[bytes, bytes] = {}  # a piece's ids as 32-bit numbers, which joining strings puts together

    def merge(self, piece: bytes) -> bytes:
        """The piece's ids, four bytes each: the adjacent pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return self.packed[piece]
        if len(piece) >= LONG_PIECE:
            return self.merge_long(piece)
        n, far, get = len(piece), len(ranks), self.ranks.get
        starts, costs = list(range(n + 1)), [get(piece[i : i + 2], far) for i in range(n - 1)]
        while costs and (low := min(costs)) < far:
            i = costs.index(low)
            del starts[i + 1], costs[i]
            if i < len(costs):
                costs[i] = get(piece[starts[i] : starts[i + 2]], far)
            if i:
                costs[i - 1] = get(piece[starts[i - 1] : starts[i + 1]], far)
        packed = self.packed
        return b"".join([packed[piece[a:b]] for a, b in zip(starts, starts[1:], strict=False)])

    def merge_long(self, piece: bytes) -> bytes:
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.packed[piece[i : end[i]]])
            i = end[i]
        return b"".join(out)

    def slices(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text's bytes and the byte offsets at which pre-tokens start, the end included."""
        data, points = text.encode(), common.code_points(text)
        found, at = [], 0
        for block in blocks(points):
            starts = token_starts(block)
            if len(data) != len(points):
                width = (1 + (block >= 0x80) + (block >= 0x800) + (block >= 0x10000)).astype(np.int64)
                offset = np.concatenate([[0], np.cumsum(width)])
                found.append(offset[starts] + at)
                at += int(offset[-1])
            else:
                found.append(starts + at)
                at += len(block)
        return data, np.append(np.concatenate(found), len(data)) if found else np.zeros(1, np.int64)

    def missed(self, piece: bytes) -> bytes:
        found = self.merge(piece)
        if len(piece) < LONG_PIECE:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the byte offsets of the pre-tokens."""
        if not text:
            return np.zeros(0, "<i4"), np.zeros(1, np.int64)
        data, offsets = self.slices(text)
        cuts, get, missed = offsets.tolist(), self.pieces.get, self.missed
        found = [get(piece := data[a:b]) or missed(piece) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.frombuffer(b"".join(found), "<i4"), offsets

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens; the vocabulary is read on the driver and is part of no package."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


_codecs: dict[str, Codec] = {}


class Shared:
    """Broadcast ranks, and their digest by which a worker knows a codec that it already has."""

    def __init__(self, spark, ranks: dict[bytes, int]):
        self.broadcast = spark.sparkContext.broadcast(ranks)
        rows = b"\n".join(b"%d %s" % (i, base64.b64encode(x)) for x, i in sorted(ranks.items()))
        self.digest = hashlib.sha256(rows).hexdigest()

    @property
    def value(self):
        return self.broadcast.value


def codec_of(shared: Shared) -> Codec:
    """One codec for each table of ranks and worker, so that its cache outlives a task."""
    if shared.digest not in _codecs:
        _codecs.clear()
        _codecs[shared.digest] = Codec(shared.value)
    return _codecs[shared.digest]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts) if parts else [], kind))


def encode(docs: DataFrame, ranks: Shared) -> DataFrame:
    """``doc_id``, ``ids``, ``offsets`` (byte offsets of the pre-tokens, the end included) for each row.

    Null counts as empty, which has no id and the offset 0.  Repeated rows are
    encoded alike, an empty table gives an empty result, texts of any length are
    encoded whole, and other columns are ignored.
    """
    return round_trip(docs, ranks).drop("decoded")


def round_trip(docs: DataFrame, ranks: Shared) -> DataFrame:
    """As ``encode``, and ``decoded``: the ids decoded again, in the same worker, so that no second one holds the ranks."""

    def run(batches):
        codec = codec_of(ranks)
        for b in batches:
            found = [codec.encode(x) for x in common.as_texts(b.column(1))]
            decoded = pa.array([codec.decode(x) for x, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), lists([x for x, _ in found], pa.int32()), lists([x for _, x in found], pa.int64()), decoded], ["doc_id", "ids", "offsets", "decoded"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, offsets array<long>, decoded binary")


def decode(encoded: DataFrame, ranks: Shared) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes that the ids stand for; null ids count as none."""

    def run(batches):
        codec = codec_of(ranks)
        for b in batches:
            ids = b.column(1)
            values, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().tolist()
            decoded = [codec.decode(values[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return common.map_batches(rows, run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_ranks(spark) -> Shared:
    import public_tokenizers

    return Shared(spark, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(common.read(spark, sf_dir, "documents"), default_ranks(spark)))
