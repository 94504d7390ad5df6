"""Text operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import bpe, common, html_content, language, language_model, licenses, media, mixing, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = "lorem ipsum dolor sit amet " * 20000
EDGE = [None, "", " \t\n", "'", "a", "one two three", "日本語 текст ñandú 12", "x" * 5000, LONG]


def table(spark, texts, schema=SCHEMA):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGE + EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "gamma", "delta,", "Word", "x1"]
    return [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(n)]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [512, 1])
def test_near_duplicates_equal_brute_force(spark, hot):
    base = texts(1, 60)
    r = random.Random(2)
    near = [" ".join(["the"] * 200 + t.split() + ["w%d" % r.randint(0, 3)]) for t in base[:40] for _ in range(3)]
    all_texts = [*base, *near, None, "", base[0]]
    found = {x.doc_id: x for x in simhash.near_duplicates(table(spark, all_texts), hot_bucket=hot).collect()}
    fps = [slow_fingerprint(t) for t in all_texts]
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            label[i] = min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 4)
    assert [found[i].fp & (2**64 - 1) for i in range(len(fps))] == fps
    changed = True
    while changed:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 4) for i in range(len(fps))]
        changed, label = new != label, new
    assert [found[i].component_id for i in range(len(fps))] == label
    assert len(set(label)) < len(label)


def test_links_grow_with_members_of_a_group_not_its_pairs(spark):
    bits = [0, *[1 << i for i in range(24)], *[1 << i | 1 << j for i in range(24) for j in range(i)]]  # any two differ in 4 bits at most
    apart = [-1, -1 ^ 1 << 60, 0x5555555555555555]
    found = simhash.links(spark.createDataFrame([(x,) for x in [*bits, *apart]], "fp long")).collect()
    assert len(found) <= 15 * len(bits)
    near = {x: x for x in [*bits, *apart]}

    def top(x):
        while near[x] != x:
            x = near[x]
        return x

    for r in found:
        near[top(r.src)] = top(r.dst)
    groups = {}
    for x in near:
        groups.setdefault(top(x), set()).add(x)
    assert sorted(groups.values(), key=len) == [{apart[2]}, set(apart[:2]), set(bits)]


def test_near_duplicates_edges(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == 2 * len(EDGE) and {r.component_id for r in rows if r.doc_id % len(EDGE) < 3} == {0}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edge.unionByName(edge))
    assert kept.columns == edge.columns
    assert kept.count() == len({r.component_id for r in rows})


def test_spark_hash_agrees_with_xxhash(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("añb c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("añb c".encode(), 42)


def slow_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(common.WORD_SPACE)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_base_equals_brute_force(spark, edge, empty):
    cases = [*texts(3, 40), "a b c d e f g h " * 5, "x\nx\n \n \nx", *EDGE[:8], "the of " * 30 + "## ** $"]
    rows = quality.judge(table(spark, cases)).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept").collect()
    for r in rows:
        assert tuple(r)[1:6] == slow_quality(cases[r.doc_id]), cases[r.doc_id]
        if r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words:
            assert r.kept is False
    assert quality.keep_good(empty).columns == empty.columns and quality.keep_good(empty).count() == 0
    assert quality.keep_good(edge).columns == edge.columns


def test_quality_rejects_symbols_and_keeps_prose(spark):
    r = random.Random(5)
    prose = [" ".join(r.choices("the of and house river walks slowly over green hills while birds sing".split(), k=120)) + "." for _ in range(40)]
    junk = ["### ".join(p.upper().split()[:60]) for p in prose[:4]]
    kept = {x.doc_id: x.kept for x in quality.judge(table(spark, prose + junk)).select("_row.doc_id", "kept").collect()}
    assert not any(kept[i] for i in range(40, 44)) and all(kept[i] for i in range(40))


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_bpe_equals_the_library(codec, monkeypatch):
    import public_tokenizers
    import regex
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(4)
    signs = "ab'stmdrevl  \n\t  1١!?.é日😀\x85\x1c '' s"
    cases = ["".join(r.choices(signs, k=r.randint(0, 300))) for _ in range(800)] + ["x" * 3000, "ab" * 500 + " " * 50, " \n" * 99, "<|endoftext|>"]
    for block in (1 << 20, 40):
        monkeypatch.setattr(bpe, "BLOCK", block)
        for t in cases:
            ids, offsets = codec.encode(t)
            assert ids.tolist() == known.encode_ordinary(t) and codec.decode(ids) == t.encode()
            cuts = [len(t[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, t)]
            assert offsets.tolist() == [*cuts, len(t.encode())]


def test_bpe_query_edges(spark, edge, empty):
    ranks = bpe.default_ranks(spark)
    rows = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(edge, ranks), ranks)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == none == rows[1].decoded_sha256
    for i, t in enumerate(EDGE):
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() == rows[i + len(EDGE)].decoded_sha256
    assert bpe.round_trip(empty, ranks).count() == 0


def test_png_round_trip_and_errors(edge, empty):
    rows = {r.doc_id: r for r in media.decode_media(media.encode_media(edge)).collect()}
    for i, t in enumerate(EDGE):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.decode_media(media.encode_media(empty)).count() == 0
    good = media.write_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    assert media.read_pngs([good])[0].ravel().tolist() == list(range(128))
    end = media.chunk(b"IEND", b"")
    head = media.chunk(b"IHDR", media.struct.pack(">IIBBBBB", 64, 2, 8, 0, 0, 0, 0))
    bomb = media.SIGNATURE + head + media.chunk(b"IDAT", zlib.compress(bytes(10**6))) + end
    odd = media.SIGNATURE + head + media.chunk(b"IDAT", zlib.compress(bytes([5] + [0] * 64) * 2)) + end
    short = media.SIGNATURE + media.chunk(b"IHDR", b"abc") + end
    broken = [b"", good[:-1], good[:40] + bytes([good[40] ^ 1]) + good[41:], short, bomb, odd]
    for x in broken:
        with pytest.raises(ValueError):
            media.read_lines(x)
    rows = [(i, 1, x) for i, x in enumerate([*broken, None, good])]
    found = {r.doc_id: r for r in media.decode_media(edge.sparkSession.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(found[i].payload_bytes is None and found[i].media_bytes == len(x) for i, x in enumerate(broken))
    assert found[len(broken)].media_sha256 is None and found[len(broken) + 1].payload_bytes == 128


def slow_unfilter(lines):
    out = [[0] * (lines.shape[1] - 1) for _ in lines]
    for y, line in enumerate(lines.tolist()):
        for x, rest in enumerate(line[1:]):
            a, b = out[y][x - 1] if x else 0, out[y - 1][x] if y else 0
            c = out[y - 1][x - 1] if x and y else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out[y][x] = (rest + [0, a, b, (a + b) // 2, nearest][line[0]]) % 256
    return out


def test_png_filters_equal_brute_force():
    r = np.random.default_rng(3)
    images = [r.integers(0, 256, (h, 9), dtype=np.uint8) for h in (1, 2, 30, 3)]
    for x in images:
        x[:, 0] = r.integers(0, 5, len(x))
    for found, x in zip(media.unfilter(images), images, strict=True):
        assert found.tolist() == slow_unfilter(x)
    smooth = (np.add.outer(np.arange(40) * 3, np.arange(64) * 2) % 256).astype(np.uint8)
    noisy = np.vstack([smooth, r.integers(0, 256, (20, 64), dtype=np.uint8), np.full((3, 64), 7, np.uint8)])
    lines = media.filtered(noisy)
    assert len(set(lines[:, 0].tolist())) >= 3 and slow_unfilter(lines) == noisy.tolist()


def test_cosine_hash_equals_the_sums():
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (64, 64), dtype=np.uint8)
    small = [[image[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range(32)] for y in range(32)]
    low = [sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if c > middle else "0" for c in low)
    assert media.cosine_hash(image) == f"{int(bits, 2):016x}"
    assert media.cosine_hash(image[:1]) == media.cosine_hash(image[:1].copy())


def test_language_held_out(spark, edge, empty):
    r = random.Random(6)
    words = {"aa": "kato miru selon tavi noma".split(), "bb": "brung gwelt schtor klimpf zwang".split()}
    rows = [(i, " ".join(r.choices(words[lang], k=30)), lang, "s", 0, 0.0) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(language.training_rows(docs))
    found = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in rows)
    mixed = spark.createDataFrame([(0, " ".join(words["aa"] * 20 + words["bb"] * 10), None, None, 0, 0.0)], SCHEMA)
    assert language.identify(mixed, model).first().mixture.startswith("aa:0.6")
    odd = {x.doc_id: x.lang_pred for x in language.identify(edge, model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[3] == "und" and odd[8] != "und"
    assert language.identify(empty, language.fit(language.training_rows(empty))).count() == 0


def test_toxicity_learns_and_survives_edges(spark, edge, empty):
    r = random.Random(7)
    calm = "river house green walks slowly over hills birds sing table".split()
    rows = [(i, " ".join(r.choices(calm, k=40) + (["vilest", "scummy"] if i % 3 == 0 else [])), "en", "s", 0, 0.0) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    found = {x.doc_id: x.predicted for x in toxicity.score(docs, model).collect()}
    assert all(found[i] == int(i % 3 == 0) for i in range(240))
    assert toxicity.keep_clean(docs, model).count() == 160 and toxicity.keep_clean(edge, model).columns == edge.columns
    assert all(0 <= x.score <= 1 for x in toxicity.score(edge, model).collect())
    both = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    odd = toxicity.training_rows(docs, both).select("doc_id", "toxic").collect()
    assert sorted((x.doc_id, x.toxic) for x in odd) == sorted((i, t) for i, t in ((1, 0), (1, 1), (3, 0)) if zlib.crc32(str(i).encode()) % 4 != 2)
    nothing = toxicity.fit(toxicity.training_rows(empty, labels))
    assert toxicity.score(empty, nothing).count() == 0


@pytest.mark.parametrize("size", [63, 64, 65, 200])
def test_toxicity_features_do_not_depend_on_blocks(monkeypatch, size):
    text = "".join(random.Random(size).choices("ab cdß ", k=size))
    whole = toxicity.features_of(text).tolist()
    for block in (64, 8, 1):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert toxicity.features_of(text).tolist() == whole
    padded = f" {text} "
    expected = {tuple(toxicity.grams(padded[i : i + n])[-1:].tolist()) for n in toxicity.SIZES for i in range(len(padded) - n + 1)}
    assert {(x,) for x in whole} == expected


def test_language_model_base_equals_brute_force(spark, edge, empty):
    cases = [*texts(8, 50), *EDGE[:7]]
    docs = table(spark, cases)
    train = [t for i, t in enumerate(cases) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter()
    for t in train:
        counts.update((t or "").encode().lower().split())
        counts["end"] += 1
    n, v = counts.total(), len(counts)
    rows = language_model.score(docs, docs.where(common.remainder("doc_id", 7) != 2)).collect()
    for r in rows:
        tokens = [*(cases[r.doc_id] or "").encode().lower().split(), "end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0
    assert language_model.score(empty, empty).count() == 0
    assert language_model.score(edge, edge.where("false")).count() == 2 * len(EDGE)


def test_suffix_tree_is_a_distribution(spark):
    docs = table(spark, texts(9, 60))
    grams = language_model.corpus_counts(docs).where("kind = 2").selectExpr("key AS code", "n")
    tree = language_model.fit_tree(grams, 1e-3, 2.0, 0.0)
    assert len(tree.child) > 5
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    by_hand = 0.0
    text = b"the of alpha"
    for i in range(len(text) + 1):
        node = 0
        for back in range(1, language_model.DEPTH + 1):
            byte = text[i - back] if i >= back else 0
            if tree.child[node, byte] < 0:
                break
            node = tree.child[node, byte]
        by_hand += float(tree.logs[node, text[i] if i < len(text) else 256])
    assert math.isclose(tree.score([b"x y", text])[1], by_hand, rel_tol=1e-5)


def test_html_blocks_and_labelled_pages():
    model = html_content.trained()
    page = "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>One  two<br>three. It is said.<p>Four <b>five</b>. So it was.<script>var t='</p>';</script></article><footer>&copy; me</footer>"
    assert model.extract(page) == "A & B\n\nOne two three. It is said.\n\nFour five. So it was."
    assert model.extract("<p>") == "" and model.extract("<" * 2000) is not None and model.extract("<div>" * 3000 + "x") is not None
    right = total = 0
    for p in html_content.pages(60, seed=5):
        tree = html_content.labelled_tree(p)
        for (node, label), q in zip(tree, model.marginals([n for n, _ in tree]), strict=True):
            if node.tag == "#text":
                right, total = right + ((q >= 0.5) == bool(label)), total + 1
    assert right / total > 0.85


def test_marginals_equal_enumeration():
    from itertools import product

    model = html_content.ContentModel({"tag:p": 0.7, "text": -0.4}, 0.1, np.array([[1.5, 0.6], [0.7, 1.3]]))
    nodes = html_content.preorder(html_content.parse("<div><p>a</p><p>b</p></div>c"))
    own = [1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0) for f in html_content.features(n))))) for n in nodes]
    place = {id(n): i for i, n in enumerate(nodes)}
    mass = np.zeros(len(nodes))
    total = 0.0
    for labels in product((0, 1), repeat=len(nodes)):
        p = math.prod(o if x else 1 - o for o, x in zip(own, labels, strict=True))
        p *= math.prod(model.edges[labels[place[id(n.parent)]]][labels[i]] for i, n in enumerate(nodes) if n.parent is not None)
        total += p
        mass += p * np.array(labels)
    assert np.allclose(mass / total, model.marginals(nodes))


def test_pages_edges(spark):
    rows = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (3, "v", "<p>" + LONG, 3)], "page_id long, url string, html string, text int")
    found = {r.page_id: r for r in html_content.extract(rows, html_content.trained()).collect()}
    assert found[1].text == found[2].text == "" and found[3].n_chars == len(found[3].text)


def test_licenses(spark, edge, empty):
    cases = ["MIT Licence\n\nCopyright (c) 2020 A. Body", "prose\nLicensed under the APACHE LICENCE, version 2.0!\nend", "nothing", None, ""]
    found = {r.doc_id: r for r in licenses.scan(table(spark, cases)).collect()}
    assert found[0].license == "MIT" and found[1].license is None and found[1].line_licenses == "Apache-2.0"
    assert found[2].n_license_lines == 0 and found[3].license is None
    assert licenses.scan(edge).count() == 2 * len(EDGE) and licenses.scan(empty).count() == 0


def test_mixing_targets_and_copies(spark, edge, empty):
    cases = [" ".join(["w"] * (1 + i % 40)) for i in range(900)]
    docs = table(spark, cases)
    sizes = Counter()
    for i, t in enumerate(cases):
        sizes[["s1", "s2", None][i % 3]] += len(t.split())
    names, weights = ["s1", "s2", None], [3, 1, 2]
    capped: set = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(w for s, w in zip(names, weights, strict=True) if s not in capped)
        new = {s for s, w in zip(names, weights, strict=True) if level * w >= 2 * sizes[s]}
        if new <= capped:
            break
        capped |= new
    wanted = {s: min(2 * sizes[s], level * w) for s, w in zip(names, weights, strict=True)}
    rates = {r.source: r for r in mixing.targets(mixing.sizes_of(docs)).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    copies = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    for s in names:
        assert math.isclose(rates[s].target, wanted[s]) and abs(taken[s] - wanted[s]) < 0.1 * wanted[s]
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == copies
    anonymous = spark.createDataFrame([(None, f"{t} {i}", "en", "one" if i % 2 else "two", 0, 0.0) for i, t in enumerate(cases)], SCHEMA)
    rates = {r.source: r.target for r in mixing.targets(mixing.sizes_of(anonymous)).collect()}
    taken = Counter()
    for r in mixing.mix(anonymous).collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - rates[s]) < 0.1 * rates[s] for s in ("one", "two"))
    assert mixing.mix(edge).columns == edge.columns and mixing.mix(empty).count() == 0


def test_suffix_tree_tests_contexts_by_count_and_joins_the_rare_ones(spark, monkeypatch):
    rare = "zq7zq7zq7zq7"
    docs = table(spark, [" ".join(["the of and"] * 3000)] * 100 + [rare] * 5)  # 20 times in 3.3 million positions
    rows = {r.doc_id: r.score for r in language_model.score(docs, docs).collect()}
    assert rows[100] > -12  # by frequent contexts alone each byte costs about 5
    keys = [0, 1, -1, 1 << 48 | 0x656820, 6 << 48 | 0x616263646566, (7 << 48) - 1]
    hashes = [r.h & 0xFFFFFFFF for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key long").selectExpr("i", "hash(key) AS h").orderBy("i").collect()]
    assert language_model.murmur(np.array(keys)).tolist() == hashes
    marks = language_model.marks_of(spark.createDataFrame([(k,) for k in keys[3:]], "key long"))
    assert language_model.marked(marks, np.array(keys)).tolist() == [False] * 3 + [True] * 3
    cases = table(spark, texts(10, 60))
    grams = language_model.corpus_counts(cases).where("kind = 2").selectExpr("key AS code", "n")
    whole = language_model.fit_tree(grams, 4, 2.0, 0.0)
    expected = whole.score([(t or "").lower().encode() for t in texts(10, 60)])
    fit = language_model.fit
    split = language_model.split
    for share, near in ((0.5, 1 << 21), (0.01, 300), (0.01, 0), (0.5, 2000), (0.0, 10)):
        monkeypatch.setattr(language_model, "fit", lambda g, share=share: fit(g, 4, 2.0, 0.0, share))
        monkeypatch.setattr(language_model, "split", lambda t, near=near: split(t, near))
        found = {r.doc_id: r.score for r in language_model.score(cases, cases).collect()}
        assert all(math.isclose(found[i], e, rel_tol=1e-5) for i, e in enumerate(expected))


def test_html_open_head_self_closed_and_deep():
    model = html_content.trained()
    article = "<article><h1>A title</h1><p>One two three. It is said.</p></article>"
    wanted = "A title\n\nOne two three. It is said."
    for start in ("<html><head><title>T</title><body>", "<head><title>T</title><meta charset=utf-8>", "<body><svg/>", "<body><math/>", "<head><title>T</title></head><body><svg><title/><path/></svg>"):
        assert model.extract(start + article) == wanted, start
    assert model.extract("<head><script>var a = '<p>';</script><style>p {}</style></head>" + article) == wanted
    deep = "<article><p>Start here. Ok.</p>{}<p>A paragraph of several words, in a deep place. It ends.</p><p>Another one of them follows here. It ends too.</p>{}</article>"
    for depth in (0, 100, 450, 3000):
        assert model.extract(deep.format("<div>" * depth, "</div>" * depth)).count("\n\n") == 2, depth
    assert model.extract("<article><p>We show <math><mi>E</mi></math> and <svg><text>F</text></svg> hold. So it is said.</p></article>") == "We show E and F hold. So it is said."
    blocks = [n for n in html_content.preorder(html_content.parse("<div>" * 600 + "<p>a</p><p>b</p>")) if n.tag == "#text"]
    assert [n.text for n in blocks] == [["a"], ["b"]]


def test_html_of_any_form_is_read():
    model, r = html_content.trained(), random.Random(13)
    signs = ["<![", "<![foo[ x", "<!", "<!--", "-->", "]]>", "<p>", "</p>", "<div>", "</div>", "<svg/>", "<a href='", "'>", "&#x", "&amp", "<script>", "</script", "<title>", "<body", "<?xml", ">", "x y", "<table><tr>", "</table>", "<li>", "\0", "<plaintext>", "<iframe>", "<select><option>", "<![CDATA[", "<![if x]>"]
    for one in signs:
        model.extract(one)
    for _ in range(3000):
        model.extract("".join(r.choices(signs, k=r.randint(2, 25))))
    assert model.extract("<article><h1>T</h1><![foo[ x ]]><p>One two three. It is said.</p></article>") == "T\n\nOne two three. It is said."


def test_quality_judges_rare_languages_by_themselves(spark):
    r = random.Random(11)

    def prose(words, n):
        return " ".join(r.choices(words.split(), k=n)) + "."

    english = "the of and house river walks slowly over green hills while birds sing"
    arabic = "البيت النهر يمشي ببطء فوق التلال الخضراء بينما الطيور تغني في الصباح"
    hindi = "घर नदी धीरे चलता हरी पहाड़ियों पर जबकि पक्षी गाते सुबह में"
    rows = [(i, prose(english, 3000), "en") for i in range(150)] + [(1000 + i, prose(arabic, 60), "ar") for i in range(45)] + [(2000, prose(hindi, 60), "hi"), (2001, prose(english, 10), "hi"), (3000, prose(arabic, 60).replace(" ", " ### "), "ar")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t), 0.5) for i, t, lang in rows], SCHEMA)
    kept = {x.doc_id: x.kept for x in quality.judge(docs).select("_row.doc_id", "kept").collect()}
    assert all(kept[i] for i, _, lang in rows if i < 2001)
    assert not kept[2001] and not kept[3000]


def test_licenses_finds_whole_texts(spark, tmp_path):
    owner = "Copyright (c) 2021 A. Body\n\n"
    files = {path.stem: path.read_text() for path in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"} <= set(files)
    cases = [("MIT", "MIT License\n\n" + owner + " ".join(files["MIT"].split())), *((n, owner + t) for n, t in files.items()), (None, files["MIT"] + "and more")]
    table(spark, [t for _, t in cases]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.license for r in licenses.op9_license_digests(spark, str(tmp_path)).collect()}
    assert [found[i] for i in range(len(cases))] == [n for n, _ in cases]
