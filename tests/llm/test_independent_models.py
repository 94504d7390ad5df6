"""Language mixtures and toxicity weights recomputed in another way."""

import itertools
import random

import numpy as np

from tessera.llm import language, toxicity

ALPHABETS = ["abcde ", "fghij ", "klmno "]


def prose(r, alphabets, n):
    return " ".join("".join(r.choices(r.choice(alphabets), k=5)).strip() for _ in range(n))


def slow_trigrams(text):
    folded = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    while "\0\0" in folded:
        folded = folded.replace("\0\0", "\0")
    out = np.zeros(language.BUCKETS, np.int64)
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        h = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
        out[(h ^ h >> 15) % language.BUCKETS] += 1
    return out


def slow_proportions(counts, p):
    """The best penalised likelihood over all sets of languages, each by many rounds of expectation-maximisation."""
    at, size = np.flatnonzero(counts), counts.sum()
    best = None
    for k in range(1, len(p) + 1):
        for chosen in itertools.combinations(range(len(p)), k):
            share = np.full(k, 1 / k)
            for _ in range(1500):
                parts = share[:, None] * p[list(chosen)][:, at]
                parts /= parts.sum(axis=0)
                share = parts @ counts[at] / size
            score = counts[at] @ np.log(share @ p[list(chosen)][:, at]) - language.PENALTY * 0.5 * np.log(size + 1) * (k - 1)
            if best is None or score > best[0]:
                best = (score, chosen, share)
    out = np.zeros(len(p))
    out[list(best[1])] = best[2]
    return out


def test_language_model_and_mixtures_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, prose(r, [ALPHABETS[i % 3]], 40), f"l{i % 3}") for i in range(60)]
    langs, log_p = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["l0", "l1", "l2"]
    table = np.full((3, language.BUCKETS), language.SMOOTHING)
    for _, text, lang in rows:
        table[int(lang[1])] += slow_trigrams(text)
    p = table / table.sum(axis=1, keepdims=True)
    np.testing.assert_allclose(np.exp(log_p), p)
    texts = [prose(r, [ALPHABETS[i] for i in mix], 60) for mix in ((0,), (1,), (0, 1), (1, 2), (0, 1, 2), (2, 2, 2, 0))]
    for text in texts:
        counts = language.trigram_counts(text)
        np.testing.assert_array_equal(counts, slow_trigrams(text))
        found, wanted = language.proportions(counts, log_p), slow_proportions(slow_trigrams(text), p)
        np.testing.assert_array_equal(found > 0, wanted > 0)
        np.testing.assert_allclose(found, wanted, atol=0.01)


def test_a_long_text_counts_as_its_parts(monkeypatch):
    text = prose(random.Random(4), ALPHABETS, 400) + " 12 !! é日"
    whole = slow_trigrams(text)
    for block in (7, 64, 1 << 20):
        monkeypatch.setattr(language, "BLOCK", block)
        np.testing.assert_array_equal(language.trigram_counts(text), whole)


def test_toxicity_weights_equal_an_independent_fit(spark):
    r = random.Random(6)
    bad, good = ["vileword", "nastyone", "uglyterm"], ["river", "garden", "window", "morning"]
    rows = [(i, " ".join(r.choices(good, k=12) + r.choices(bad, k=i % 2 * r.randint(1, 3))), i % 2, 1.0) for i in range(80)]
    rows += [(100 + i, "vileword " + " ".join(r.choices(good, k=9)), 0, 1.0) for i in range(3)]  # labels are not separable
    weights, bias = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int, share double"))

    # the ratios, by counting sets of n-grams
    sets = [frozenset(toxicity.features_of(t).tolist()) for _, t, _, _ in rows]
    y = np.array([x for _, _, x, _ in rows], float)
    every = sorted(set().union(*sets))
    x = np.array([[g in s for g in every] for s in sets], float)
    often = x.sum(axis=0) >= toxicity.LEAST_DOCS
    x = x[:, often]
    p, q = (x[y == 1].sum(axis=0) + 1) / (y.sum() + 2), (x[y == 0].sum(axis=0) + 1) / ((1 - y).sum() + 2)
    ratio = np.log(p / q)
    assert len(ratio) < toxicity.FEATURES
    scaled = x * ratio
    scaled /= np.sqrt(max(1.0, (scaled**2).sum() / len(y)))

    # the ridge regression's loss: no direction from the fitted weights lowers it much
    kept = np.array(every)[often]
    factor = ratio / np.sqrt(max(1.0, ((x * ratio) ** 2).sum() / len(y)))
    w = weights[kept] / np.where(factor == 0, 1, factor)

    def loss(w, b):
        z = scaled @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE / 2 * (w @ w)

    # Newton's method on the kernel form is small: there are fewer rows than features
    a, b = np.zeros(len(y)), 0.0
    kernel = scaled @ scaled.T
    for _ in range(60):
        odds = 1 / (1 + np.exp(-(kernel @ a + b)))
        curve = odds * (1 - odds) + 1e-12
        left = np.block([[kernel * curve[:, None] / len(y) + toxicity.RIDGE * np.eye(len(y)), curve[:, None] / len(y)], [curve[None, :] @ kernel / len(y), np.array([[curve.sum() / len(y)]])]])
        right = np.concatenate([(odds - y) / len(y) + toxicity.RIDGE * a, [(odds - y).sum() / len(y)]])
        step = np.linalg.lstsq(left, right, rcond=None)[0]
        a, b = a - step[:-1], b - step[-1]
    best = loss(scaled.T @ a, b)
    assert best - 1e-9 <= loss(w, bias) <= best + 0.01
    agree = (1 / (1 + np.exp(-(kernel @ a + b))) >= toxicity.THRESHOLD) == (toxicity.probabilities([t for _, t, _, _ in rows], weights, bias) >= toxicity.THRESHOLD)
    assert agree.mean() > 0.97
