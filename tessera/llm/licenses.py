"""License scans by canonical digests, with DataFrame functions only.

A text is normalised (case, white space and punctuation, equivalent spellings,
copyright notices) and its SHA-256 joined to the digests of known license texts
and notices: whole texts first, and each line by the same digests.  White space
and the marks of comments are folded before anything else is read, so wrapping
does not matter.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.storage import materialize

# Licenses by their public short identifiers, and the names that notices give them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "Expat License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "Unlicense": ["Unlicense"],
}
# The sentences that notices are made of.
NOTICES = ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This software is released under the {}.", "SPDX-License-Identifier: {}"]
# Spellings that mean the same in a license, British before American.
SPELLINGS = {"licence": "license", "organisation": "organization", "authorisation": "authorization", "whilst": "while", "merchantable": "merchantability", "sub license": "sublicense", "non commercial": "noncommercial", "per cent": "percent", "copyright holder": "copyright owner"}
# Lines that stand above a text that has no title of its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "All rights reserved.", "BSD 2-Clause License\nAll rights reserved."],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "All rights reserved.", "BSD 3-Clause License\nAll rights reserved."],
}
#: Known digests that are broadcast at most; more are joined.
BROADCAST_DIGESTS = 100_000
#: What ends the terms of a text; an appendix on how to apply them may follow.
TERMS_END = "END OF TERMS AND CONDITIONS"
VERSIONS = r"\b(?:version|ver|v) ?([0-9])"


#: Words of a known text by which its beginning is recognised behind titles and notices.
START_WORDS = 6
#: Words of a copyright notice at the end of a text, at most.
NOTICE_WORDS = 15
# A copyright notice, as against "copyright notice", "copyright holder" and the like, goes on with one of these.
NOTICE = "(?:copyright|c) (?:c|by|[0-9]{4})"


def normalised(text: Column, keep: str = "") -> Column:
    """The text in small letters, its words parted by one space (by the character ``keep`` where it stands), in one spelling; null is empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}{keep}]+", " ")
    for spelling, same in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return F.regexp_replace(out, VERSIONS, "v $1")


def canonical_words(text: str) -> list[str]:
    """The words of a known text as ``normalised`` has them."""
    out = re.sub(r"[\W_]+", " ", text.lower())
    for spelling, same in SPELLINGS.items():
        out = out.replace(spelling, same)
    return re.sub(VERSIONS, r"v \1", out).split()


def before_terms(texts: list[tuple[str, str]]) -> str:
    """A pattern of what may stand before the first words of a known text, a title and copyright notices; these words are its group."""
    starts = sorted({" ".join(w[:START_WORDS]) for w in (canonical_words(t) for _, t in texts) if len(w) > 2 * START_WORDS}, key=lambda x: (-len(x), x))
    titles = sorted({" ".join(canonical_words(t)) for x in TITLES.values() for t in x}, key=lambda x: (-len(x), x))
    return f"^(?:(?:{'|'.join(titles)}) )?(?:{NOTICE} .*? )?(?:all rights reserved )?({'|'.join(starts)})" if starts else ""


#: A copyright notice at the end of a text.
AFTER_TERMS = f" {NOTICE}(?: [^ ]+){{0,{NOTICE_WORDS}}}$"


def digest(text: Column, before: str) -> Column:
    """SHA-256 of the canonical text, without the title and notices before its terms and a notice after them."""
    out = F.btrim(normalised(text))
    if before:
        out = F.regexp_replace(out, before, "$1")
    return F.sha2(F.regexp_replace(out, AFTER_TERMS, ""), 256)


def notices() -> list[tuple[str, str]]:
    """Known texts: (license, text), built from the fixed values; a caller may pass whole license texts as well."""
    return [(name, n.format(x)) for name, names in NAMES.items() for x in dict.fromkeys([name, *names]) for n in NOTICES]


def whole_texts() -> list[tuple[str, str]]:
    """The license texts of ``license_texts``, as they are, below each title, and without what follows the terms."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        out += [(name, text), *((name, f"{x}\n\n{text}") for x in TITLES.get(name, []))]
        if TERMS_END in text:
            terms = text[: text.index(TERMS_END)]
            out += [(name, terms), (name, terms + TERMS_END)]
    return out


def known_digests(spark, texts: list[tuple[str, str]]) -> DataFrame:
    """``digest``, ``license``: one row for each digest, the first license by name if two share one."""
    table = spark.createDataFrame(texts, "license string, text string")
    return table.groupBy(digest(F.col("text"), before_terms(texts)).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id``, ``digest``, ``license`` (of the whole text, else null), ``n_license_lines``, ``line_licenses``.

    Null and empty texts have the digest of the empty text and no license.  The
    known digests are as many as the caller's texts (the built-in notices if they
    are None), and are held by the driver.  Of licenses that share a digest, the
    least by name counts.  Repeated rows are judged alike, an empty table gives an
    empty result, texts of any length are scanned whole, and other columns are
    ignored.
    """
    texts = notices() if texts is None else texts
    known = materialize(known_digests(docs.sparkSession, texts), "digests")
    if len(texts) <= BROADCAST_DIGESTS:
        known = F.broadcast(known)
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_key")
    # equal texts have equal hits, so one of each is enough
    lines = docs.select(key, F.posexplode(F.split(normalised(F.col("text"), keep="\n"), "\n")).alias("_line", "_text"))
    hits = lines.select("_key", "_line", F.sha2(F.btrim("_text"), 256).alias("digest")).join(known, "digest").groupBy("_key", "_line").agg(F.min("license").alias("license"))
    hits = hits.groupBy("_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    hits = materialize(hits, "license-lines")  # so that Spark knows its size, and may split texts that many rows share
    rows = docs.select("doc_id", key, digest(F.col("text"), before_terms(texts)).alias("digest")).join(known, "digest", "left").join(hits, "_key", "left")
    return rows.select("doc_id", "digest", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("licenses", F.lit("")).alias("line_licenses"))


def op9_license_digests(spark, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"), notices() + whole_texts())


def sql() -> str:
    """The same in DuckDB's SQL."""
    texts = notices() + whole_texts()

    def canonical(text, keep=""):
        out = rf"regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}{keep}]+', ' ', 'g')"
        for spelling, same in SPELLINGS.items():
            out = f"replace({out}, '{spelling}', '{same}')"
        return rf"regexp_replace({out}, '{VERSIONS}', 'v \1', 'g')"

    def whole(text):
        return rf"sha256(regexp_replace(regexp_replace(trim({canonical(text)}), '{before_terms(texts)}', '\1'), '{AFTER_TERMS}', ''))"

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in texts)
    return rf"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (SELECT license, {whole("text")} AS digest FROM (VALUES {rows}) v(license, text)) GROUP BY digest),
texts AS (SELECT row_number() OVER () AS r, doc_id, {canonical("text", chr(92) + "n")} AS t, {whole("text")} AS digest FROM documents),
lines AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM (SELECT r, sha256(trim(unnest(string_split(t, chr(10))))) AS digest FROM texts) JOIN known USING (digest)
  GROUP BY r)
SELECT texts.doc_id, texts.digest, known.license, coalesce(lines.n, 0)::BIGINT AS n_license_lines, coalesce(lines.licenses, '') AS line_licenses
FROM texts LEFT JOIN known ON known.digest = texts.digest LEFT JOIN lines ON lines.r = texts.r
"""
