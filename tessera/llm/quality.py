"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes, and its histogram of common words,
are compared with those of the languages in the table by Jensen-Shannon
distance; the nearest language counts.  Short texts scatter more, so the
distance allowed falls with the square root of what was counted, and below a
minimum length a histogram is not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.storage import materialize

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
# The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
CLASSES = ["lower", "upper", "digit", "space", "symbol", "rest"]
#: The references of a language with this share of all characters are compared with every document; there are 1 / LANGUAGE_SHARE at most.
LANGUAGE_SHARE = 0.01
#: Any other language with so many characters has references for its own documents; with fewer, they are not judged by distance.
LEAST_LANGUAGE_CHARS = 10_000
#: A word is common in a language if it makes up this share of its words, so a language has 1 / WORD_SHARE at most.
WORD_SHARE = 0.005
#: Distances allowed: a constant and a part that is divided by the root of the number of words.
CLASS_DISTANCE = (0.13, 1.1)
WORD_DISTANCE = (0.255, 0.85)
#: Words below which a word histogram is not judged.
LEAST_WORDS_JUDGED = 40


def word_list(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    inner = F.btrim(text, F.lit(common.WORD_SPACE))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.WORD_SPACE_CLASS + "+"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as struct ``_row`` with ``_words``, the class counts and the base measures."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", word_list(F.col("_text")))
    left = "_text"
    for name, pattern in zip(CLASSES[:-1], [r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", common.WORD_SPACE_CLASS + "+", SYMBOLS + "+"], strict=True):
        rows = rows.withColumn(f"_without_{name}", F.regexp_replace(left, pattern, ""))
        rows = rows.withColumn(f"_{name}", F.length(left) - F.length(f"_without_{name}"))
        left = f"_without_{name}"
    rows = rows.withColumn("_rest", F.length(left)).drop(*[f"_without_{n}" for n in CLASSES[:-1]])
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(common.WORD_SPACE)) != "")
    rows = rows.withColumn("_lines", lines)
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("word_chars", (F.length("_text") - F.col("_space")).cast("long"))
    rows = rows.withColumn("n_symbols", F.col("_symbol").cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    return repeated_words(rows)


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows found twice or more.  Windows are compared by 64-bit hashes."""
    hashes = F.transform("_words", lambda w, i: F.xxhash64(F.slice("_words", i + 1, WINDOW)))
    rows = rows.withColumn("_windows", F.when(F.size("_words") > WINDOW, F.slice(hashes, 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(1)))))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")  # most texts repeat none and need no sorting
    rows = rows.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    met = F.filter("_sorted", lambda x, j: (F.get("_sorted", j - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get("_sorted", j + 1)["h"] == x["h"]).eqNullSafe(True))
    rows = rows.withColumn("_starts", F.array_sort(F.transform(met, lambda x: x["i"])))
    spans = F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_windows", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


class References:
    """Class shares, common words, and the shares of these words and of all others, for all rows together and for each frequent language.

    ``rare`` has a row for each other language with enough text (``_lang``,
    ``_q``, ``_common``, ``_shares``); it is None if there is no other language.
    """

    def __init__(self, classes: list[list[float]], vocabulary: list[str], words: list[list[float]], langs: list[str] | None = None, rare: DataFrame | None = None):
        self.classes, self.vocabulary, self.words, self.langs, self.rare = classes, vocabulary, words, langs or [], rare


def references(docs: DataFrame) -> References:
    """Both kinds of reference over all rows of ``docs``; a null language, or one below LEAST_LANGUAGE_CHARS, counts in the joint one only."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("_text"))
    counted = rows
    left = "_text"
    for name, pattern in zip(CLASSES[:-1], [r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", common.WORD_SPACE_CLASS + "+", SYMBOLS + "+"], strict=True):
        counted = counted.withColumn(f"_without_{name}", F.regexp_replace(left, pattern, ""))
        counted = counted.withColumn(name, F.length(left) - F.length(f"_without_{name}"))
        left = f"_without_{name}"
    sums = materialize(counted.withColumn("rest", F.length(left)).groupBy("lang").agg(*[F.sum(c).alias(c) for c in CLASSES]), "classes")
    whole = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES]).first()
    total = sum(whole[c] for c in CLASSES)
    if not total:
        return References([], [], [])
    own = sums.where((F.col("lang") != "") & (sum(F.col(c) for c in CLASSES) >= LANGUAGE_SHARE * total)).orderBy("lang").collect()
    classes = [[r[c] / max(1, sum(r[x] for x in CLASSES)) for c in CLASSES] for r in [whole, *own]]

    langs = [r["lang"] for r in own]
    known = F.when(F.col("lang").isin(langs), F.col("lang")).otherwise("") if langs else F.lit("")
    tokens = rows.select("lang", F.explode(word_list(F.col("_text"))).alias("word"))
    every = materialize(tokens.groupBy("lang", "word").count(), "words")
    others = sums.where((F.col("lang") != "") & ~F.col("lang").isin(langs))
    rare = None
    counts = every
    if others.limit(1).count():
        rare = materialize(rare_references(others, every), "rare-languages")
        counts = materialize(every.groupBy(known.alias("lang"), "word").agg(F.sum("count").alias("count")), "words")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    often = F.lit(False)
    for lang in langs:
        often |= (F.col("lang") == lang) & (F.col("count") >= max(2.0, WORD_SHARE * sizes.get(lang, 0)))
    # at most 1 / (LANGUAGE_SHARE * WORD_SHARE) words are common in some language, and each has a row for each language
    vocabulary = [r["word"] for r in counts.where(often).select("word").distinct().orderBy("word").collect()]
    place = {w: i for i, w in enumerate(vocabulary)}
    found = counts.where(F.col("word").isin(vocabulary)).collect() if vocabulary else []
    words = []
    for wanted in [None, *langs]:
        n = [0] * len(vocabulary)
        for r in found:
            if wanted in (None, r["lang"]):
                n[place[r["word"]]] += r["count"]
        size = sum(sizes.values()) if wanted is None else sizes.get(wanted, 0)
        if sum(n):
            words.append([x / size for x in [*n, size - sum(n)]])
    return References(classes, vocabulary, words, langs, rare)


def rare_references(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """``_lang``, class shares ``_q``, common words ``_common``, and ``_shares`` of these and all others, from class sums and word counts by language."""
    total = sum(F.col(c) for c in CLASSES)
    own = sums.where(total >= LEAST_LANGUAGE_CHARS).select("lang", F.array(*[F.col(c) / total for c in CLASSES]).alias("_q"))
    sizes = counts.groupBy("lang").agg(F.sum("count").alias("size"))
    shares = counts.join(F.broadcast(own.join(sizes, "lang")), "lang").where(F.col("count") >= F.greatest(F.lit(2.0), WORD_SHARE * F.col("size")))
    common_words = F.array_sort(F.collect_list(F.struct("word", (F.col("count") / F.col("size")).alias("share"))))
    found = shares.groupBy("lang").agg(common_words.alias("w"))
    out = own.join(found, "lang", "left").select(F.col("lang").alias("_lang"), "_q", F.col("w.word").alias("_common"), F.col("w.share").alias("_known"))
    return out.withColumn("_shares", F.array_append("_known", F.greatest(F.lit(0.0), F.lit(1.0) - summed(F.col("_known"))))).drop("_known")


def distance(parts: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * parts))


def half(p: Column, q: Column) -> Column:
    """p log2(2 p / (p + q)), 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def summed(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def word_runs(rows: DataFrame, vocabulary: Column, common_word) -> DataFrame:
    """Adds ``_runs``: place in the vocabulary and share of each common word, and of all others; null if the text is too short to be judged, or the vocabulary null."""
    rows = rows.withColumn("_hits", F.array_sort(F.filter("_words", common_word)))
    rows = rows.withColumn("_first", F.filter(F.transform("_hits", lambda w, i: F.when(F.get("_hits", i - 1).eqNullSafe(w), None).otherwise(i)), lambda i: i.isNotNull()))
    runs = F.transform("_first", lambda p, j: F.struct(F.array_position(vocabulary, F.get("_hits", p)).cast("int").alias("k"), ((F.coalesce(F.get("_first", j + 1), F.size("_hits")) - p) / F.col("n_words")).alias("p")))
    others = F.struct((F.size(vocabulary) + 1).alias("k"), ((F.col("n_words") - F.size("_hits")) / F.col("n_words")).alias("p"))
    return rows.withColumn("_runs", F.when((F.col("n_words") >= LEAST_WORDS_JUDGED) & vocabulary.isNotNull(), F.array_append(runs, others))).drop("_hits", "_first")


def apart(q: Column) -> Column:
    """Distance of ``_runs`` from a reference; its words that the text lacks add their whole share."""
    return distance(F.lit(1.0) + summed(F.transform("_runs", lambda r: half(r["p"], F.element_at(q, r["k"])) + half(F.element_at(q, r["k"]), r["p"]) - F.element_at(q, r["k"]))))


def likely_languages(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """``_key``, ``_like``: for texts without a label the rare language of which most common words occur in the text, the least by name of equal ones."""
    words = rows.select("_key", F.explode(F.array_distinct("_words")).alias("word"))
    common_words = rare.select("_lang", F.explode("_common").alias("word"))
    found = words.join(common_words, "word").groupBy("_key", "_lang").agg(F.countDistinct("word").alias("n"))
    return found.groupBy("_key").agg(F.min_by("_lang", F.struct(-F.col("n"), "_lang")).alias("_like"))


def verdicts(rows: DataFrame, refs: References) -> DataFrame:
    """Adds ``class_distance``, ``word_distance`` (null where not judged) and ``kept``."""
    if not refs.classes:
        return rows.withColumn("class_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double")).withColumn("kept", ~base_failed())
    total = sum(F.col(f"_{c}") for c in CLASSES)
    rows = rows.withColumn("_p", F.array(*[F.col(f"_{c}") / F.greatest(total, F.lit(1)) for c in CLASSES]))
    known = F.array(*[F.array(*map(F.lit, q)) for q in refs.classes])

    def from_classes(q):
        return distance(summed(F.zip_with("_p", q, lambda x, y: half(x, y) + half(y, x))))

    rows = rows.withColumn("class_distance", F.array_min(F.transform(known, from_classes)))
    if refs.words:
        vocabulary = F.array(*map(F.lit, refs.vocabulary))
        rows = word_runs(rows, vocabulary, lambda w: w.isin(refs.vocabulary))
        shares = F.array(*[F.array(*map(F.lit, q)) for q in refs.words])
        rows = rows.withColumn("word_distance", F.when(F.col("_runs").isNotNull(), F.array_min(F.transform(shares, apart)))).drop("_runs")
    else:
        rows = rows.withColumn("word_distance", F.lit(None).cast("double"))
    lang = F.coalesce("_row.lang", F.lit(""))
    judged = lang.isin(["", *refs.langs])
    if refs.rare is not None:
        unlabelled = rows.where(lang == "").withColumn("_key", F.md5(F.col("_text").cast("binary")))
        rows = rows.where(lang != "").withColumn("_like", F.col("_row.lang")).unionByName(unlabelled.join(likely_languages(unlabelled, refs.rare), "_key", "left").drop("_key"))
        # one row for each language that has enough text
        rows = rows.join(F.broadcast(refs.rare), F.col("_like") == F.col("_lang"), "left")
        rows = word_runs(rows, F.col("_common"), lambda w: F.array_contains("_common", w))
        rows = rows.withColumn("class_distance", F.least("class_distance", F.when(F.col("_q").isNotNull(), from_classes(F.col("_q")))))
        rows = rows.withColumn("word_distance", F.least("word_distance", F.when(F.col("_runs").isNotNull(), apart(F.col("_shares"))))).drop("_runs")
        judged |= F.col("_lang").isNotNull()
    far = F.col("class_distance") > CLASS_DISTANCE[0] + CLASS_DISTANCE[1] / F.sqrt(F.greatest("n_words", F.lit(1)))
    odd = F.coalesce(F.col("word_distance") > WORD_DISTANCE[0] + WORD_DISTANCE[1] / F.sqrt(F.greatest("n_words", F.lit(1))), F.lit(False))
    return rows.withColumn("kept", ~base_failed() & ~(judged & (far | odd)))


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict for each row, the row itself in struct ``_row``.

    Null text counts as empty: no words, base_failed.  References come from all
    rows of the same table.  A row whose language has no reference has distances
    but is not rejected by them; one without a language is judged by the nearest
    of the frequent languages and of the rare one whose common words it has most
    of.  A distance equal to the one
    allowed passes.  Repeated rows are judged alike, texts of any length are
    measured whole, and an empty table gives an empty result; further columns,
    whatever their names, stay in ``_row``.
    """
    return verdicts(measured(docs), references(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that ``judge`` keeps, repeated ones alike, with the columns of ``docs``.

    Null and empty texts go, having no words.  A generator picks them: a filter would be pushed below the projections, and
    their array expressions computed anew in each place that names them.
    """
    return judge(docs).select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def op3_quality_divergence(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    out = judge(docs).withColumn("base_failed", base_failed())
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w1 AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, regexp_replace(t, '\p{{Ll}}+', '', 'g') AS t1 FROM d),
w2 AS (SELECT *, regexp_replace(t1, '\p{{Lu}}+', '', 'g') AS t2 FROM w1),
w3 AS (SELECT *, regexp_replace(t2, '\p{{Nd}}+', '', 'g') AS t3 FROM w2),
w4 AS (SELECT *, regexp_replace(t3, '[\x20\x09-\x0D]+', '', 'g') AS t4 FROM w3),
w5 AS (SELECT *, regexp_replace(t4, '{SYMBOLS}+', '', 'g') AS t5 FROM w4),
c AS (SELECT doc_id, lang, words, lines, [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5)] AS n, length(t) AS size FROM w5),
parts AS (SELECT doc_id, lang, size, unnest(n) AS n, unnest(range(6)) AS k FROM c),
sums AS (SELECT lang, k, sum(n) AS n FROM parts GROUP BY lang, k),
own AS (SELECT lang FROM sums WHERE lang <> '' GROUP BY lang HAVING sum(n) >= {LANGUAGE_SHARE} * (SELECT sum(n) FROM sums)),
rare AS MATERIALIZED (SELECT lang FROM sums WHERE lang <> '' AND lang NOT IN (SELECT lang FROM own) GROUP BY lang HAVING sum(n) >= {LEAST_LANGUAGE_CHARS}),
class_refs AS (  -- those of rare languages are for their own documents only
  SELECT lang AS ref, k, n::DOUBLE / greatest(1, sum(n) OVER (PARTITION BY lang)) AS q, lang NOT IN (SELECT lang FROM own) AS only
  FROM sums WHERE lang IN (SELECT lang FROM own) OR lang IN (SELECT lang FROM rare)
  UNION ALL SELECT '*', k, sum(n)::DOUBLE / (SELECT sum(n) FROM sums), false FROM sums GROUP BY k),
rare_counts AS (SELECT lang AS rare, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM c WHERE lang IN (SELECT lang FROM rare)) GROUP BY lang, word),
rare_known AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY rare) AS size FROM rare_counts) WHERE n >= greatest(2, {WORD_SHARE} * size)),
likely AS (  -- of a text without a language, the rare one that most of its words are common in
  SELECT doc_id, rare FROM (SELECT doc_id, rare, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(list_distinct(words)) AS word FROM c WHERE lang = '') JOIN rare_known USING (word) GROUP BY doc_id, rare)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rare) = 1),
likened AS (SELECT c.doc_id, CASE WHEN c.lang = '' THEN l.rare WHEN c.lang IN (SELECT lang FROM rare) THEN c.lang END AS rare FROM c LEFT JOIN likely l ON l.doc_id = c.doc_id),
class_distance AS (
  SELECT doc_id, min(distance) AS distance FROM (
    SELECT doc_id, ref, sqrt(greatest(0, 0.5::DOUBLE * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END))) AS distance
    FROM (SELECT doc_id, rare, k, n::DOUBLE / greatest(size, 1) AS p FROM parts JOIN likened USING (doc_id)) p JOIN class_refs f ON f.k = p.k AND (NOT f.only OR f.ref = p.rare) GROUP BY doc_id, ref) GROUP BY doc_id),
words AS (SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM own) THEN lang ELSE '' END AS lang, likened.rare, unnest(words) AS word FROM c JOIN likened USING (doc_id)),
counts AS (SELECT lang, word, count(*) AS n FROM words GROUP BY lang, word),
sizes AS (SELECT lang, sum(n) AS size FROM counts GROUP BY lang),
vocabulary AS (SELECT DISTINCT word FROM counts JOIN sizes USING (lang) WHERE lang <> '' AND n >= greatest(2, {WORD_SHARE} * size)),
ref_counts AS (
  SELECT lang AS ref, word, n FROM counts WHERE lang <> '' AND word IN (SELECT word FROM vocabulary)
  UNION ALL SELECT '*', word, sum(n) FROM counts WHERE word IN (SELECT word FROM vocabulary) GROUP BY word),
ref_sizes AS (SELECT lang AS ref, size FROM sizes WHERE lang <> '' UNION ALL SELECT '*', sum(size) FROM sizes),
word_refs AS (
  SELECT ref, word, n::DOUBLE / size AS q FROM ref_counts JOIN ref_sizes USING (ref)
  UNION ALL SELECT ref, NULL, (any_value(size) - sum(n))::DOUBLE / any_value(size) FROM ref_counts JOIN ref_sizes USING (ref) GROUP BY ref),
hits AS (SELECT doc_id, word, count(*) AS n FROM words WHERE word IN (SELECT word FROM vocabulary) GROUP BY doc_id, word),
judged AS (SELECT doc_id, rare, len(words) AS size FROM c JOIN likened USING (doc_id) WHERE len(words) >= {LEAST_WORDS_JUDGED}),
runs AS (
  SELECT doc_id, word, n::DOUBLE / size AS p FROM hits JOIN judged USING (doc_id)
  UNION ALL SELECT j.doc_id, NULL, (any_value(j.size) - coalesce(sum(h.n), 0))::DOUBLE / any_value(j.size) FROM judged j LEFT JOIN hits h ON h.doc_id = j.doc_id GROUP BY j.doc_id),
rare_refs AS (
  SELECT rare AS ref, word, n::DOUBLE / size AS q FROM rare_known
  UNION ALL SELECT rare, NULL, greatest(0::DOUBLE, 1::DOUBLE - sum(n::DOUBLE / size)) FROM rare_known GROUP BY rare),
rare_hits AS (SELECT doc_id, w.rare, w.word, count(*) AS n FROM words w JOIN rare_known k ON k.rare = w.rare AND k.word = w.word GROUP BY ALL),
rare_runs AS (
  SELECT doc_id, h.rare AS ref, word, n::DOUBLE / size AS p FROM rare_hits h JOIN judged USING (doc_id)
  UNION ALL SELECT j.doc_id, any_value(j.rare), NULL, (any_value(j.size) - coalesce(sum(h.n), 0))::DOUBLE / any_value(j.size)
  FROM judged j LEFT JOIN rare_hits h ON h.doc_id = j.doc_id WHERE j.rare IN (SELECT ref FROM rare_refs) GROUP BY j.doc_id),
word_distance AS (
  SELECT doc_id, min(distance) AS distance FROM (
    SELECT doc_id, ref, sqrt(greatest(0, 0.5::DOUBLE * (1 + sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END - q)))) AS distance
    FROM (SELECT r.doc_id, r.word, r.p, f.ref, coalesce(x.q, 0) AS q FROM runs r CROSS JOIN (SELECT DISTINCT ref FROM word_refs) f LEFT JOIN word_refs x ON x.ref = f.ref AND x.word IS NOT DISTINCT FROM r.word
      UNION ALL SELECT r.doc_id, r.word, r.p, r.ref, x.q FROM rare_runs r JOIN rare_refs x ON x.ref = r.ref AND x.word IS NOT DISTINCT FROM r.word)
    GROUP BY doc_id, ref) GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM c WHERE len(words) >= {WINDOW})),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM windows) WHERE k > 1) GROUP BY doc_id),
base AS (
  SELECT c.doc_id, c.lang = '' OR c.lang IN (SELECT ref FROM class_refs WHERE ref <> '*') AS judged, len(words)::BIGINT AS n_words, (size - c.n[4])::BIGINT AS word_chars, c.n[5]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM c LEFT JOIN repeated r ON r.doc_id = c.doc_id)
SELECT b.* EXCLUDE (judged), (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)
    AND NOT (judged AND (k.distance > {CLASS_DISTANCE[0]}::DOUBLE + {CLASS_DISTANCE[1]}::DOUBLE / sqrt(greatest(n_words, 1))
      OR coalesce(w.distance > {WORD_DISTANCE[0]}::DOUBLE + {WORD_DISTANCE[1]}::DOUBLE / sqrt(greatest(n_words, 1)), false))) AS kept,
  round(k.distance, 6) AS class_distance, round(w.distance, 6) AS word_distance
FROM base b JOIN class_distance k ON k.doc_id = b.doc_id LEFT JOIN word_distance w ON w.doc_id = b.doc_id
"""
