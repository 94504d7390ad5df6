"""Near duplicates by five-word shingles, against all pairs."""

import random

from tessera.llm import similar_sets, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or both >= 0.8 * either:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def test_components_equal_those_of_all_pairs(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([30, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(rnd.choice([0, 3, 12])):
            copy = list(base)
            for _ in range(int(len(base) * rnd.choice([0.0, 0.01, 0.02, 0.03, 0.06]))):
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    rows += ["", None, " \t\n", "one two", "ONE two", "x " * 30000]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_sets.near_duplicates(docs).collect()}
    assert got == brute_force(rows)
    kept = simhash.keep_one(docs, similar_sets.near_duplicates(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_null_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, "a b", 7), (None, None, 8)], "doc_id long, text string, key int")
    assert [r.component_id for r in similar_sets.near_duplicates(docs).orderBy("component_id").collect()] == [None, 1, 1, 1]
    assert similar_sets.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs, similar_sets.near_duplicates(docs))
    assert kept.columns == docs.columns and kept.count() == 3


def test_one_of_several_texts_of_an_id_stays(spark):
    docs = spark.createDataFrame([(1, "b b", 1), (1, "a a", 2), (1, "a a", 1), (2, "c", 9), (None, "a a", 3), (None, None, 4)], "doc_id long, text string, gone_id int")
    kept = simhash.keep_one(docs, similar_sets.near_duplicates(docs)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.gone_id) for r in kept) == [(0, "", 4), (0, "a a", 3), (1, "a a", 1), (2, "c", 9)]
