"""Language model scoring with a probabilistic suffix tree over bytes.

The tree's states are contexts of up to ``DEPTH`` preceding bytes.  A context
is a candidate if it occurs ``LEAST_COUNT`` times, so the candidates grow with
the corpus.  It is retained, with its suffixes, if its next-byte distribution
diverges from its parent's: count times relative entropy, in nats, of at least
``LEAST_GAIN`` and ``SYMBOL_COST`` times the logarithm of all positions for each
symbol seen after it (the length of a description of its distribution).
Contexts that ``HEAD_CONTEXT_SHARE`` of all positions have are looked up in a
broadcast tree with a full row of probabilities each; the next most frequent
ones, of ``NEAR_PAIRS`` symbols together, in a broadcast sorted array of the
symbols seen; all others stay a table that is joined.
Distributions are smoothed towards the parent's (Witten and Bell), the root's
towards the uniform one.  A text's score is the sum of the log probabilities of
its bytes and its end, each in the longest retained suffix state.

The base score is an add-one unigram model over whole words.  The most frequent
words, ``HEAD_WORDS`` of them at most, are looked up in a broadcast table; the
others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common
from tessera.storage import discard, materialize

#: A code holds this many context bytes and nine bits of the next symbol in a long.
DEPTH = 6
#: Fewer occurrences would need over 3.75 nats each to reach LEAST_GAIN.
LEAST_COUNT = 8
HEAD_CONTEXT_SHARE = 4e-5
LEAST_GAIN = 30.0
SYMBOL_COST = 0.5
#: Symbols after contexts that the broadcast array holds at most: 12 bytes each.
NEAR_PAIRS = 3 << 19
#: Bits of the filter that tells which contexts the table has; a power of two.
MARKS = 1 << 25
#: Words of the broadcast table at most: the most frequent ones.
HEAD_WORDS = 1 << 16
#: Next symbols: the bytes, and the end of the text.
END = 256
#: In place of a child: it is in the table.
TAIL = -2
#: Distinct words, and positions, that a task counts before it hands on the counts so far.
FLUSH_WORDS, FLUSH_POSITIONS = 300_000, 1 << 22


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For a batch: DEPTH zeros, the bytes and the end of each text in turn; the index of each text's first zero."""
    sizes = np.array([len(x) + DEPTH + 1 for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(b"\0" * DEPTH + x + b"\0" for x in texts), np.uint8).astype(np.int16)
    flat[starts[1:] - 1] = END
    return flat, starts


def gram_codes(flat: np.ndarray, starts: np.ndarray, nearest_first: bool = False) -> np.ndarray:
    """For each byte and end: the DEPTH bytes before it (the nearest one lowest, or highest) above nine bits of the symbol itself."""
    low = (flat & 0xFF).astype(np.int64)
    code = np.zeros(len(flat) - DEPTH, np.int64)
    for back in range(1, DEPTH + 1) if nearest_first else range(DEPTH, 0, -1):
        code <<= 8
        code |= low[DEPTH - back : len(low) - back]
    code <<= 9
    code |= flat[DEPTH:]
    wanted = np.ones(len(flat), bool)
    wanted[(starts[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return code[wanted[DEPTH:]]


def turned(code: np.ndarray) -> np.ndarray:
    """Codes with the nearest byte highest as codes with it lowest."""
    return (code >> 9 << 64 - 8 * DEPTH).byteswap() << 9 | code & 511


def batches_of(texts: list[bytes], most: int):
    """Lists of texts of about ``most`` bytes; a longer text stands alone."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x) + DEPTH + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_codes, kind="stable")
    all_codes, all_counts = all_codes[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_codes[1:] != all_codes[:-1]]))
    return all_codes[first], np.add.reduceat(all_counts, first)


#: Kinds of count: ends of texts, words, and positions by their code.
ENDS, WORDS, CODES = range(3)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(kind, key, word, n)`` over all texts; only words have a word, and only positions a key that is not 0."""

    def run(batches):
        words: Counter = Counter()
        ends, codes, counts, pending = 0, [], [], 0

        def out(kind, keys, n, word=None):
            found = pa.nulls(len(n), pa.binary()) if word is None else pa.array(word, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), pa.array(keys, pa.int64()), found, pa.array(n, pa.int64())], ["kind", "key", "word", "n"])

        def out_words():
            return out(WORDS, np.zeros(len(words), np.int64), list(words.values()), list(words))

        for b in batches:
            texts = [x.lower() for x in common.as_bytes(b.column(0))]  # of bytes: lowers A-Z only
            ends += len(texts)
            for x in texts:
                words.update(x.split())
                if len(words) > FLUSH_WORDS:
                    yield out_words()
                    words.clear()
            for group in batches_of(texts, FLUSH_POSITIONS // 4):
                code, n = np.unique(gram_codes(*symbols(group)), return_counts=True)
                codes.append(code)
                counts.append(n)
                pending += len(code)
                if pending > FLUSH_POSITIONS:
                    code, n = merged(codes, counts)
                    codes, counts, pending = [code], [n], len(code)
                    if pending > FLUSH_POSITIONS // 2:
                        yield out(CODES, code, n)
                        codes, counts, pending = [], [], 0
        if ends:
            yield out(ENDS, [0], [ends])
            yield out_words()
        if codes:
            yield out(CODES, *merged(codes, counts))

    raw = common.map_batches(docs.select("text"), run, "kind byte, key long, word binary, n long")
    # tasks have counted already: dealt by key first, their rows are not hashed a second time before the shuffle
    return materialize(raw.repartition("kind", "key", "word").groupBy("kind", "key", "word").agg(F.sum("n").alias("n")), "corpus-counts")


class SuffixTree:
    """Retained contexts as a trie read backwards, with a row of log10 probabilities for each.

    A child of TAIL is retained, but its row is in the table beside the tree.
    """

    def __init__(self, child: np.ndarray, logs: np.ndarray, depth: int):
        self.child, self.logs, self.depth = child, logs, depth

    def score(self, texts: list[bytes]) -> list[float]:
        """log10 probability of each text, without the positions that lead to the table."""
        return [total for total, *_ in self.parts(texts)]

    def parts(self, texts: list[bytes], near: Near | None = None):
        """For each text its log10 probability as far as the tree and ``near`` have it, and of the positions that lead to the table: codes, how often, their depths and log10 probabilities so far."""
        for group in batches_of(texts, FLUSH_POSITIONS // 4):
            flat, starts = symbols(group)
            code, place = np.unique(gram_codes(flat, starts, True), return_inverse=True)
            # in this order the codes of one context stand together, and those of one node near each other
            new = np.ones(len(code), bool)
            new[1:] = code[1:] >> 9 != code[:-1] >> 9
            context = code[new] >> 9
            node, alive = np.zeros(len(context), np.int32), np.arange(len(context))
            depth = np.full(len(context), -1, np.int8)
            for back in range(self.depth):
                found = self.child[node[alive], context[alive] >> 8 * (DEPTH - 1 - back) & 0xFF]
                depth[alive[found == TAIL]] = back
                alive, found = alive[found >= 0], found[found >= 0]
                node[alive] = found
            which = np.cumsum(new) - 1
            depth = depth[which]
            logs = self.logs[node[which], code & 511].astype(np.float64)
            far = np.flatnonzero(depth >= 0)
            if near is not None and len(far):
                depth[far], logs[far], still = near.follow(code[far], depth[far], logs[far])
                far = far[still]
            first = starts[:-1] - DEPTH * np.arange(len(group))
            above = logs[far].copy()
            logs[far] = 0
            totals = np.add.reduceat(logs[place], first).tolist()
            if not len(far):
                yield from ((total, far, far, far, above) for total in totals)
                continue
            number = np.full(len(code), -1, np.int64)
            number[far] = np.arange(len(far))
            number = number[place]
            open_ = np.flatnonzero(number >= 0)
            cuts = np.searchsorted(open_, np.append(first, len(number)))
            for total, a, b in zip(totals, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                used, times = np.unique(number[open_[a:b]], return_counts=True)
                yield total, turned(code[far[used]]), times, depth[far[used]], above[used]


class Near:
    """Retained contexts below the tree, as sorted arrays: keys and back-offs; (key's place, symbol) and log10 probabilities; and a filter of the keys in the table."""

    def __init__(self, table: pa.Table, marks: np.ndarray | None = None):
        key = table.column("key").to_numpy()
        d = key >> 8 * DEPTH
        key = (key & (np.int64(1) << 8 * DEPTH) - 1).byteswap().view(np.uint64) >> (64 - 8 * d).astype(np.uint64)
        key = key.view(np.int64) + (d << 8 * DEPTH)  # nearest byte highest, as in the codes that are looked up
        order = np.argsort(key, kind="stable")
        self.keys, self.marks, table = key[order], marks, table.take(order)
        self.backoff = np.log10(table.column("backoff").to_numpy())
        sizes, seen, p = (pc.list_value_length(table.column("seen")).to_numpy(), *(pc.list_flatten(table.column(c)).to_numpy() for c in ("seen", "p")))
        pairs = np.repeat(np.arange(len(sizes)), sizes) << 9 | seen
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.logs = pairs[order], np.log10(p[order]).astype(np.float32)

    def follow(self, code: np.ndarray, depth: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depth and log10 probability of each code (nearest byte highest) in its longest context here, and whether the table may have a longer one."""
        depth, above, open_ = depth.copy(), above.copy(), np.zeros(len(code), bool)
        alive = np.arange(len(code))
        while len(alive):
            alive = alive[depth[alive] < DEPTH]
            d = depth[alive].astype(np.int64) + 1
            key = (code[alive] >> 9 + 8 * (DEPTH - d)) + (d << 8 * DEPTH)
            if len(self.keys):
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                same = self.keys[place] == key
            else:
                place, same = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            if self.marks is not None:
                left, d = alive[~same], d[~same]
                open_[left] = marked(self.marks, (turned(code[left]) >> 9 & (np.int64(1) << 8 * d) - 1) + (d << 8 * DEPTH))
            alive, place = alive[same], place[same]
            pair = place << 9 | code[alive] & 511
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            above[alive] = np.where(self.pairs[at] == pair, self.logs[at], self.backoff[place] + above[alive])
            depth[alive] += 1
        return depth, above, open_


def murmur(key: np.ndarray) -> np.ndarray:
    """Spark's hash() of a long, as an unsigned number."""
    h = np.full(len(key), 42, np.uint32)
    for part in (key.astype(np.uint32), (key >> 32).astype(np.uint32)):
        k = part * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h ^= k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return h ^ h >> np.uint32(16)


def marked(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    h = murmur(key) & np.uint32(MARKS - 1)
    return (marks[h >> np.uint32(6)] >> (h & np.uint32(63)).astype(np.int64) & 1).astype(bool)


def marks_of(keys: DataFrame) -> np.ndarray:
    """A bit for the hash of each key, MARKS bits in all, put together by Spark; a key that is not there seldom has one, while they are fewer than the bits."""
    h = F.hash("key").bitwiseAND(F.lit(MARKS - 1))
    words = keys.select(F.shiftright(h, 6).alias("word"), F.expr("shiftleft(1L, hash(key) & 63)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def masked(d: int) -> Column:
    return F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1))


def fit(grams: DataFrame, least_count: float = LEAST_COUNT, least_gain: float = LEAST_GAIN, symbol_cost: float = SYMBOL_COST, head_share: float = HEAD_CONTEXT_SHARE) -> tuple[SuffixTree, DataFrame]:
    """The tree of frequent contexts from ``(code, n)``, and the table of the other retained ones.

    The table has ``key`` (length and context), ``backoff``, ``whole`` (its count) and ``symbols``, the
    probabilities of the symbols that follow.  A frequent context is one that
    head_share of all positions have: the driver gets 257 rows for each of at most
    1 / head_share of each length, and which of their children are retained.
    No key of a join has more than 257 rows of a side, one for each byte or symbol.
    """
    flat = grams.select(F.shiftright("code", 9).alias("context"), F.col("code").bitwiseAND(F.lit(511)).cast("short").alias("symbol"), "n")
    by_depth = {DEPTH: flat}
    for d in range(DEPTH - 1, -1, -1):
        by_depth[d] = materialize(by_depth[d + 1].groupBy(masked(d).alias("context"), "symbol").agg(F.sum("n").alias("n")), "grams")
    root = by_depth[0].toPandas()[["context", "symbol", "n"]].to_numpy(np.int64)
    total = int(root[:, 2].sum())
    head = max(1.0, head_share * total)
    spark = grams.sparkSession
    start = grow([root]).logs[0].astype(float)
    above = spark.createDataFrame([(0, i, 10.0**x, total) for i, x in enumerate(start.tolist())], "parent long, symbol short, above double, parent_whole long")
    levels, tested, retained = [], [], []
    for d in range(1, DEPTH + 1):
        each = Window.partitionBy("context")
        rows = by_depth[d].select("*", F.sum("n").over(each).alias("whole"), F.count("*").over(each).alias("kinds")).where(F.col("whole") >= least_count)
        rows = rows.withColumn("parent", masked(d - 1)).join(above, ["parent", "symbol"])
        rows = materialize(rows.withColumn("p", (F.col("n") + F.col("kinds") * F.col("above")) / (F.col("whole") + F.col("kinds"))), "level")
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("whole") / F.col("above")))
        tested.append(materialize(rows.groupBy("context").agg((gain - symbol_cost * math.log(max(2, total)) * F.first("kinds")).alias("spare"), gain.alias("gain"), F.first("whole").alias("whole"), F.first("parent_whole").alias("parent_whole")), "gains"))
        levels.append(rows)
        above = rows.select(F.col("context").alias("parent"), "symbol", F.col("p").alias("above"), F.col("whole").alias("parent_whole"))
    kept: DataFrame | None = None  # suffixes of retained contexts stay
    edges, tables = [], []
    for d in range(DEPTH, 0, -1):
        some = tested[d - 1].withColumn("own", (F.col("gain") >= least_gain) & (F.col("spare") >= 0))
        if kept is not None:
            some = some.join(kept.select(masked(d).alias("context")).distinct().withColumn("below", F.lit(True)), "context", "left").where(F.col("own") | F.col("below").isNotNull())
        else:
            some = some.where("own")
        kept = materialize(some.select("context", "whole", "parent_whole"), "retained")
        retained.append(kept)
        tail = kept.where(F.col("whole") < head)
        edges.append(tail.where(F.col("parent_whole") >= head).select(F.lit(d).alias("d"), "context"))
        rows = levels[d - 1].where(F.col("whole") < head).join(tail.select("context"), "context", "left_semi")
        pairs = F.map_from_entries(F.collect_list(F.struct("symbol", "p")))
        tables.append(rows.groupBy("context").agg(F.first(F.col("kinds") / (F.col("whole") + F.col("kinds"))).alias("backoff"), F.first("whole").alias("whole"), pairs.alias("symbols")).select((F.col("context") + F.lit(d << 8 * DEPTH)).alias("key"), "backoff", "whole", "symbols"))
    frequent = [x.where(F.col("whole") >= head).join(kept.select("context"), "context", "left_semi").select(F.lit(d).alias("d"), "context", "symbol", "n") for d, (x, kept) in enumerate(zip(levels, reversed(retained), strict=True), 1)]
    table = sorted_rows(reduce(DataFrame.unionByName, frequent).toArrow().sort_by([("d", "ascending"), ("context", "ascending"), ("symbol", "ascending")]))
    below = sorted_rows(reduce(DataFrame.unionByName, edges).toArrow())
    tree = grow([root, *(table[table[:, 0] == d][:, 1:] for d in range(1, DEPTH + 1))], [below[below[:, 0] == d][:, 1].tolist() for d in range(1, DEPTH + 1)])
    tail = materialize(reduce(DataFrame.unionByName, tables), "tail")
    discard(*(by_depth[d] for d in range(DEPTH)), *levels, *tested, *retained)
    return tree, tail


def sorted_rows(table: pa.Table) -> np.ndarray:
    return np.stack([c.to_numpy().astype(np.int64) for c in table.columns], axis=1)


def fit_tree(grams: DataFrame, least_count: float = LEAST_COUNT, least_gain: float = LEAST_GAIN, symbol_cost: float = SYMBOL_COST) -> SuffixTree:
    """All retained contexts in one tree on the driver, for small corpora."""
    return fit(grams, least_count, least_gain, symbol_cost, 0.0)[0]


def steps_of(column: str) -> Column:
    """The power of two that a count reaches."""
    return F.floor(F.log2(F.col(column) + 0.5)).cast("int")


def least_step(rows: DataFrame, column: str, size: Column, most: int) -> int:
    """The least power of two such that the rows whose count reaches it have ``size`` of at most ``most`` together; 64 if none have."""
    least, held = 64, 0
    for r in rows.groupBy(steps_of(column).alias("step")).agg(F.sum(size).alias("n")).orderBy(F.desc("step")).collect():  # 64 rows at most
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    return least


def split(tail: DataFrame, most: int = NEAR_PAIRS) -> tuple[Near, DataFrame | None]:
    """The contexts of the table that are broadcast, at most ``most`` symbols together and the most frequent ones, and the table of the others, None if there is none."""
    size, least = steps_of("whole"), least_step(tail, "whole", F.size("symbols"), most)
    near, rest = tail.where(size >= least), tail.where(size < least)
    if not rest.limit(1).count():
        rest = None
    pairs = F.map_entries("symbols")
    table = near.select("key", "backoff", F.transform(pairs, lambda x: x["key"].cast("int")).alias("seen"), F.transform(pairs, lambda x: x["value"]).alias("p")).toArrow()
    return Near(table, None if rest is None else marks_of(rest)), rest


def tail_logs(far: DataFrame, tail: DataFrame) -> DataFrame:
    """``code``, ``log``: log10 probability of each code in ``far`` (code, depth, above) in its longest retained context, for codes that have one in ``tail``."""
    codes = far.groupBy("code").agg(F.first("depth").alias("depth"), F.first("above").alias("above"))
    asked = codes.select("*", F.explode(F.sequence(F.col("depth") + 1, F.lit(DEPTH))).alias("d"))
    mask = F.expr("shiftleft(1L, 8 * d) - 1")
    asked = asked.withColumn("key", F.shiftright("code", 9).bitwiseAND(mask) + F.expr(f"shiftleft(cast(d as long), {8 * DEPTH})"))
    found = asked.join(tail, "key").select("code", "above", F.struct("d", F.try_element_at("symbols", F.col("code").bitwiseAND(F.lit(511)).cast("short")).alias("p"), "backoff").alias("step"))
    # from the shortest context on: a symbol seen there has its own probability, another the shorter context's share
    steps = found.groupBy("code").agg(F.first("above").alias("above"), F.array_sort(F.collect_list("step")).alias("steps"))
    p = F.aggregate("steps", F.pow(F.lit(10.0), F.col("above")), lambda acc, x: F.coalesce(x["p"], x["backoff"] * acc))
    return steps.select("code", F.log10(p).alias("log"))


def grow(levels: list[np.ndarray], below: list[list[int]] | None = None) -> SuffixTree:
    """Smoothing, level by level, from sorted rows (context, symbol, count) of retained contexts; ``below`` has the retained contexts of each level that are in the table, and whose parents are here."""
    size = END + 1
    root = np.bincount(levels[0][:, 1], levels[0][:, 2], size) if len(levels[0]) else np.zeros(size)
    kinds = np.count_nonzero(root)
    probabilities = [((root + (kinds + 1) / size) / (root.sum() + kinds + 1)).astype(np.float32)]
    child = {}  # (node, byte) -> node
    places: dict[int, int] = {0: 0}
    leads = []  # (node, byte) that lead to the table
    for d, rows in enumerate(levels[1:], 1):
        for context in below[d - 1] if below else []:
            leads.append((places[context & ((1 << 8 * (d - 1)) - 1)], context >> 8 * (d - 1)))
        here: dict[int, int] = {}
        if len(rows):
            contexts, first = np.unique(rows[:, 0], return_index=True)
            ends = np.append(first[1:], len(rows))
            for context, a, b in zip(contexts.tolist(), first.tolist(), ends.tolist(), strict=True):
                parent = places[context & ((1 << 8 * (d - 1)) - 1)]
                n = np.zeros(size, np.float32)
                n[rows[a:b, 1]] = rows[a:b, 2]
                here[context] = child[parent, context >> 8 * (d - 1)] = len(probabilities)
                probabilities.append((n + (b - a) * probabilities[parent]) / (rows[a:b, 2].sum() + b - a))
        places = here
    table = np.full((len(probabilities), 256), -1, np.int32)
    for (parent, byte), node in child.items():
        table[parent, byte] = node
    for parent, byte in leads:
        table[parent, byte] = TAIL
    return SuffixTree(table, np.log10(np.array(probabilities, np.float32)), len(levels) - 1)


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for each row of ``docs``.

    Null counts as the empty text, which is one token, its end.  Repeated rows
    are scored alike, each on its own row.  With no training row every count is
    0 and the tree is the uniform distribution.
    """
    counted = corpus_counts(train)
    words, grams = counted.where(F.col("kind") == WORDS).select("word", "n"), counted.where(F.col("kind") == CODES).select(F.col("key").alias("code"), "n")
    totals = {r["kind"]: r for r in counted.where(F.col("kind") != CODES).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n, v = (sum(r[c] for r in totals.values()) for c in ("n", "v"))
    ends = totals[ENDS]["n"] if ENDS in totals else 0
    context = docs.sparkSession.sparkContext
    least = 2.0 ** least_step(words.select("n"), "n", F.lit(1), HEAD_WORDS)
    frequent = words.where(F.col("n") >= least).toArrow()  # HEAD_WORDS rows at most
    head = context.broadcast(dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True)))
    fitted, tail = fit(grams)
    close, rest = split(tail)
    tree, near = context.broadcast(fitted), context.broadcast(close)

    def run(batches):
        known, model, beside, log10 = head.value, tree.value, near.value, math.log10
        for b in batches:
            texts = [x.lower() for x in common.as_bytes(b.column(1))]
            tokens, hits, sums, cuts, unknown, repeats = [], [], [], [0], [], []
            for x in texts:
                counted = Counter(x.split())
                found, total = ends and 1, log10(ends + 1)
                for word, times in counted.items():
                    if (c := known.get(word)) is None:
                        unknown.append(word)
                        repeats.append(times)
                    else:
                        found += times
                        total += times * log10(c + 1)
                cuts.append(len(unknown))
                for into, y in zip((tokens, hits, sums), (1 + counted.total(), int(found), total), strict=True):
                    into.append(y)
            scored = list(model.parts(texts, beside))
            ends_of = np.cumsum([0, *(len(x[1]) for x in scored)])
            kinds = (pa.int64(), pa.int32(), pa.int8(), pa.float64())
            open_rows = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in scored]) if scored else [], k) for i, k in enumerate(kinds, 1)], ["code", "times", "depth", "above"])
            far = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), open_rows)
            rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(unknown, pa.binary()), pa.array(repeats, pa.int64())], ["word", "times"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(sums, pa.float64()), pa.array([x[0] for x in scored], pa.float64()), rest, far], ["doc_id", "n_tokens", "head_known", "head_sum", "head_score", "rest", "far"])

    schema = "doc_id long, n_tokens long, head_known long, head_sum double, head_score double, rest array<struct<word: binary, times: long>>, far array<struct<code: long, times: int, depth: byte, above: double>>"
    # written with their numbers, so that a lost task cannot number them anew
    rows = materialize(common.map_batches(docs.select("doc_id", "text"), run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    rare = rare.join(words.where(F.col("n") < least), "word")
    rare = rare.groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_sum"))
    out = rows.drop("rest", "far").join(rare, "row", "left")
    if rest is None:
        out = out.withColumn("tail_score", F.lit(0.0))
    else:
        far = rows.select("row", F.inline("far"))
        more = far.join(tail_logs(far, rest), "code", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("log", "above")).alias("tail_score"))
        out = out.join(more, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )


def op8_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, docs.where(common.remainder("doc_id", 7) != 2))
    return out.select("doc_id", (common.remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
