"""Substring dedup, fill-in-middle and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import fill_middle, periodic, repeats

SCHEMA = "doc_id long, text string, key string, h1 long, words string, alone string, n long, runs string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "k", 1, "w", "a", 2, "r") for i, t in enumerate(texts)], SCHEMA)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# substring dedup


def slow_repeats(texts, window):
    words = [split(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        drop = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(drop), " ".join(x for k, x in enumerate(w) if k not in drop)))
    return out


def shared_texts(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["the"] * 60 + ["ñandú", "日本"]
    passages = [r.choices(words, k=k) for k in (34, 35, 36, 50, 90)]
    out = []
    for _ in range(n):
        parts = [r.choices(words, k=r.randint(0, 60)) for _ in range(r.randint(1, 3))]
        parts.insert(r.randint(0, len(parts)), r.choice(passages))
        out.append(r.choice([" ", "\n", " \t "]).join(x for p in parts for x in p))
    return out


@pytest.mark.parametrize(("window", "cell_bits"), [(35, 20), (35, 4), (5, 16), (20, 16)])
def test_repeats_equal_brute_force(spark, window, cell_bits):
    """A sketch of 16 cells estimates nearly all windows repeated; the exact pass mends that."""
    base = shared_texts(window, 60)
    periodic_text = " ".join(["a", "b", "c"] * 30)
    texts = [*base, None, "", " \n", "one word", base[0], base[0], base[1].replace(" ", "\n"), periodic_text, "x " * 80, "y " * 35]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(table(spark, texts).repartition(5), window, cell_bits=cell_bits).collect()}
    wanted = slow_repeats(texts, window)
    assert [found[i] for i in range(len(texts))] == wanted
    assert any(0 < n < m for m, n, _ in wanted) and any(n == 0 for _, n, _ in wanted)


def test_sketch_never_underestimates(spark):
    texts = shared_texts(3, 40)
    bits = repeats.sketch(table(spark, texts), 35, cell_bits=18)
    batch = repeats.Batch([t.encode() for t in texts], 35, repeats.Hashes())
    estimated = repeats.estimated(batch.anchors, bits, repeats.ROWS, 18)
    h1, h2 = batch.digests()
    count = Counter(zip(h1.tolist(), h2.tolist(), strict=True))
    often = np.array([count[x] > 1 for x in zip(h1.tolist(), h2.tolist(), strict=True)])
    assert often.any() and estimated[often].all() and estimated.sum() < 0.5 * len(estimated)
    assert len(batch.chosen) < len(batch.starts) / 3


def test_rolling_hashes_equal_direct_sums():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 100, np.uint64)
    for size in (1, 2, 5, 20, 35, 100):
        direct = [sum(int(h) * pow(repeats.BASES[0], j, 1 << 64) for j, h in enumerate(hashes[i : i + size])) % (1 << 64) for i in range(101 - size)]
        assert repeats.rolling(hashes, size, repeats.BASES[0]).tolist() == direct


def test_repeats_edges(spark):
    assert repeats.without_repeats(table(spark, []), cell_bits=16).count() == 0
    long = " ".join("v%d" % (i * i % 100003) for i in range(60_000))
    text = " ".join("u%d" % i for i in range(40))
    rows = table(spark, [long, long + " tail", text, text, text], [0, None, 7, 7, None])
    found = sorted((r.n_words, r.n_removed, r.kept[-4:]) for r in repeats.without_repeats(rows, cell_bits=22).collect())
    assert found == [(40, 40, "")] * 3 + [(60_000, 60_000, ""), (60_001, 60_000, "tail")]


# fill-in-middle


def slow_fill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_brute_force(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(["\n", "a", "é", "日", "😀", " ", "\r", "<", "P>", "S", ">", " "], [6, 9, 3, 3, 2, 4, 1, 1, 1, 1, 1, 1], k=r.randint(0, 90))) for _ in range(300)]
    texts += [None, "", "\n", "\n\n\n", "no break", "ends\n", "has <M> mark\n", "<S", "\n<", "x" * 200_000, ("line of text\n" * 30_000) + "end"]
    ids = [*range(len(texts) - 3), 3, 3, None]
    out = {}
    for x in fill_middle.fill_in_middle(table(spark, texts, list(range(len(texts))))).collect():
        out[x.doc_id] = (x.n, x.form, x.prefix_chars, x.middle_chars, x.output)
        assert x.restored == (texts[x.doc_id] or "")
    assert [out[i] for i in range(len(texts))] == [slow_fill(i, t) for i, t in enumerate(texts)]
    assert {x[1] for x in out.values()} == {"plain", "psm", "spm"}
    again = sorted(map(str, ((x.n, x.form, x.output[:50]) for x in fill_middle.fill_in_middle(table(spark, texts, ids)).collect())))
    assert again == sorted(map(str, ((n, f, o[:50]) for n, f, _, _, o in (slow_fill(i, t) for i, t in zip(ids, texts, strict=True)))))
    assert fill_middle.fill_in_middle(table(spark, [])).count() == 0


def test_selection_by_halving():
    r = random.Random(1)
    for _ in range(50):
        width = r.randint(1, 400)
        bits = r.getrandbits(width) | 1 << r.randrange(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [fill_middle.select(bits, k, width) for k in range(len(places))] == places


def test_rates(spark):
    texts = ["a\nb\nc\n"] * 200
    forms = Counter(r.form for r in fill_middle.fill_in_middle(table(spark, texts), rate=50, spm=20).collect())
    assert 60 < forms["plain"] < 140 and forms["spm"] < forms["psm"]


# periodic runs


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            smallest = next(p for p in range(1, len(part) + 1) if all(part[k] == part[k + p] for k in range(len(part) - p)))
            if smallest == q and len(part) >= max(6, 4 * q):
                out.append((start, len(part), q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def run_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choices("abcdefgh", k=r.randint(0, 20)) if r.random() < 0.5 else (r.choices("abc", k=r.randint(1, 9)) * 12)[: r.randint(3, 60)]
        out.append(" ".join(words))
    return out


def test_runs_equal_brute_force(spark):
    texts = [*run_texts(8, 250), None, "", " ", "a " * 5, "a " * 6, "a b " * 4, "a b a b a b a", ("a a a a a a b " * 9), "a a a a a a a a b b b b b b b b " * 5]
    found = {r.doc_id: r for r in periodic.periodic_runs(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words, r = split(t), found[i]
        runs = slow_runs(words)
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words), t
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        assert r.collapsed == " ".join(w for k, w in enumerate(words) if k not in drop)
    assert sum(len(r.runs) > 1 for r in found.values()) > 20


def test_long_periods_and_texts(spark):
    r = random.Random(2)
    block = ["w%d" % r.randrange(5000) for _ in range(1237)]
    noise = ["n%d" % r.randrange(50) for _ in range(70_000)]
    text = " ".join([*noise, *(block * 5)[:6000], *noise[::-1]])
    runs = periodic.periodic_runs(table(spark, [text, "z " * 20_000])).collect()
    assert [tuple(x) for x in runs[0].runs] == [(70_000, 6000, 1237)]
    assert [tuple(x) for x in runs[1].runs] == [(0, 20_000, 1)] and runs[1].collapsed == "z"


def test_screen_loses_no_lag():
    r = random.Random(4)
    for _ in range(300):
        q = r.randint(1, 40)
        head, tail = r.randint(0, 50), r.randint(0, 50)
        period = [r.randrange(1000) for _ in range(q)]
        length = r.randint(max(6, 4 * q), 6 * q + 6)
        ids = np.array([r.randrange(1000) for _ in range(head)] + (period * 12)[:length] + [r.randrange(1000) for _ in range(tail)])
        if length >= 4 * q and 4 * q <= len(ids):
            assert q in periodic.possible_lags(ids)


def test_stretches():
    assert periodic.stretches(0b1110_0111_1101, 3) == [(2, 5), (9, 3)]
    assert periodic.stretches(0, 1) == [] and periodic.stretches(0b111, 4) == []


def planted_words(doc_id, text):
    words, h = split(text), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark, tmp_path):
    texts = [*run_texts(9, 120), None, "", " ".join("t%d" % i for i in range(300))]
    ids = [*range(len(texts) - 1), None]
    table(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in periodic.op13_periodic_runs(spark, str(tmp_path)).collect():
        words = planted_words(row.doc_id, texts[row.doc_id if row.doc_id is not None else -1])
        runs = slow_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        milli = 1000 * best[1] // best[2] if runs else None
        wanted = (len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))
        assert tuple(row)[1:] == wanted
    table(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert periodic.op13_periodic_runs(spark, f"{tmp_path}/empty").count() == 0
