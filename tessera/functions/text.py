"""Scalar text functions as Column builders; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def norm_name(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(collapse(F.lower(x)))


def norm_activity_name(x: Column) -> Column:
    """As norm_name, asterisks read as spaces."""
    return norm_name(F.replace(x, F.lit("*"), F.lit(" ")))


def norm_starred_name(x: Column) -> Column:
    """Lower case, leading asterisks dropped, white space collapsed."""
    return collapse(F.ltrim(F.trim(F.lower(x)), F.lit("*")))


def norm_path(x: Column) -> Column:
    return collapse(F.btrim(F.lower(x), F.lit("/")))


def norm_table(x: Column) -> Column:
    """The last dotted segment, lower case, outer quotes stripped first."""
    return F.element_at(F.split(F.lower(F.btrim(x, F.lit('"'))), r"\."), -1)


def family_base(name: Column, least: int = 10) -> Column:
    """What stands before the last " - " if it is long enough, else the name."""
    left = F.trim(F.regexp_extract(name, r"(?s)^(.*) - ", 1))
    return F.when(F.length(left) >= least, left).otherwise(F.trim(name))


def variant_suffix(name: Column, base: Column) -> Column:
    rest = F.ltrim(F.substr(name, F.length(base) + 1), F.lit(" -"))
    return F.when(F.startswith(name, base), rest).otherwise(name)


# What the normalisers of statements mask or tidy, for hashes, vectors, differences and display, as patterns
# and replacements in order; and what a statement of a script is: from its first word up to what begins something else, or the end.
HASH_MASKS = [
    (r"--[^\n]*", ""),
    (r"(?s)/\*.*?\*/", ""),
    (r"set\s+query_group\s*=\s*'[^']*'\s*;?\s*", ""),
    (r"\b[a-z0-9]{6,}zmd\d{3}\b", "ZTMP"),
    (r"\bzzt\w+\b", "ZTMP"),
    (r"\bpa\d+\b", "pa0"),
    (r"'[^']*'", "'?'"),
    (r"\b\d+(?:\.\d+)?\b", "0"),
]
VECTOR_MASKS = [
    (r"(?s)/\*.*?\*/", " "),
    (r"'(?:''|[^'])*'", "?"),
    (r"--[^\n]*", " "),
]
LOWER_VECTOR_MASKS = [
    (r"\b(?:zz[a-z]{2}\d+(?:_\w+)?|dss_int\w*|tmp_\w+|temp_\w+|#?[a-z]*_temp_[a-z0-9_]+)\b", "tmp_tbl"),
    (r"\b[a-f0-9]{16,}\b", "hashtok"),
    (r"\b\d+(?:\.\d+)?\b", "?"),
]
DIFF_MASKS = [
    (r"'[^']*'", "'?'"),
    (r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?\b", "<DATE>"),
    (r"\bMSTR=[^;']+;", "MSTR=<NAME>;"),
]
PRETTY = [(r"\r\n", "\n"), (r"\t", "  "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]
BLOCK = r"(?is)\b(?:select|with|insert\s+into)\b.*?(?=\bcreate\s+(?:temporary\s+)?table\b|\bdrop\s+table\b|\bset\s+\w+\s+to\b|\breset\s+\w+\b|\binsert\s+into\b|\z)"


def replaced(x: Column, masks: list[tuple[str, str]]) -> Column:
    for pattern, to in masks:
        x = F.regexp_replace(x, pattern, to)
    return x


def sql_for_hash(sql: Column) -> Column:
    """Statement text with comments, report headers, temporary names and literals masked; comments go first, as hashes need."""
    return F.trim(collapse(replaced(F.lower(sql), HASH_MASKS)))


def sql_for_vectors(sql: Column, most: int = 2000) -> Column:
    """As above for embeddings: strings, doubled quotes included, are masked before line comments are cut."""
    return F.substring(F.trim(collapse(replaced(F.lower(replaced(sql, VECTOR_MASKS)), LOWER_VECTOR_MASKS))), 1, most)


def sql_for_diff(sql: Column) -> Column:
    return replaced(sql, DIFF_MASKS)


def pretty_sql(sql: Column) -> Column:
    return F.btrim(replaced(sql, PRETTY), F.lit(" \n\r\t"))


def sql_blocks(sql: Column, least: int = 20) -> Column:
    """The queries of a script, each without the semicolons at its end; trivial ones are left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(BLOCK), F.lit(0)), lambda x: F.rtrim(F.btrim(x, F.lit(" \n\r\t")), F.lit(";")))
    return F.filter(found, lambda x: F.length(x) > least)


def tables_of(sql: Column) -> Column:
    """Names after FROM, then after JOIN, quotes and brackets stripped, each once."""
    found = F.concat(F.regexp_extract_all(sql, F.lit(r"(?i)\bfrom\s+([\w.\"\[\]]+)"), F.lit(1)), F.regexp_extract_all(sql, F.lit(r"(?i)\bjoin\s+([\w.\"\[\]]+)"), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r'["\[\]]', "")))


def content_hash(*parts: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def jitter(x: Column) -> Column:
    """A number in [0, 1) with four decimals from the md5 of a key."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long") % 10000 / F.lit(10000.0)


def name_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))


def location(path: Column) -> Column:
    return F.when(F.lower(path).contains("/profiles/"), "Personal").when(F.lower(path).contains("/public"), "Public").otherwise("Other")


def report_blob(name: Column, owner: Column, metrics: Column, sql: Column, most: int = 6000) -> Column:
    """Labelled lines; the statement is left out, then the end cut, if the text is too long."""
    whole = F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Owner: "), owner), F.concat(F.lit("Metrics: "), metrics), F.concat(F.lit("SQL: "), sql))
    short = F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Owner: "), owner), F.concat(F.lit("Metrics: "), metrics))
    return F.when(F.length(whole) <= most, whole).otherwise(F.substring(short, 1, most))


def plain(json: Column) -> Column:
    """Text of a JSON value: a string as it is, an object's name or id, a list's texts joined by slashes, null empty."""
    kind = F.substring(F.ltrim(json), 1, 1)
    name = F.coalesce(F.nullif(F.get_json_object(json, "$.name"), F.lit("")), F.get_json_object(json, "$.id"), F.lit(""))
    items = F.transform(F.from_json(json, "array<string>"), lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.nullif(F.get_json_object(x, "$.name"), F.lit("")), F.get_json_object(x, "$.id"), F.lit(""))).otherwise(x))
    joined = F.array_join(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), "/")
    bare = F.when(kind == '"', F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x")).otherwise(json)
    return F.coalesce(F.when(F.lower(json) == "null", "").when(kind == "{", name).when(kind == "[", joined).otherwise(bare), F.lit(""))


def labelled(fields: dict[str, Column], id_: Column) -> Column:
    """Lines ``LABEL: value`` of the fields that are not blank; the id if all are."""
    lines = F.concat_ws("\n", *[F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}: "), x)) for label, x in fields.items()])
    return F.when(lines == "", F.concat(F.lit("ID: "), id_)).otherwise(lines)


def listed(values: Column, most: int | None = None) -> Column:
    return F.array_join(values if most is None else F.slice(values, 1, most), "; ")


def file_name(x: Column, most: int = 80) -> Column:
    """A name that file systems take: odd signs, white space and underscores become one underscore."""
    out = F.regexp_replace(F.regexp_replace(F.trim(x), r'[<>:"/\\|?*]', "_"), r"[\s_]+", "_")
    out = F.btrim(out, F.lit("_. "))
    out = F.when(F.length(out) > most, F.rtrim(F.substring(out, 1, most), F.lit("_"))).otherwise(out)
    return F.when(F.coalesce(out, F.lit("")) == "", "unnamed").otherwise(out)


def python_round(x: Column, digits: int) -> Column:
    """Half-even rounding of the binary value: a tie that the decimal digits only seem to have is none."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def prompt_answers(prompts: Column) -> Column:
    """Of prompts (type, key, id, answers, default) those with an answer: key, type and answer."""
    answer = lambda p: F.coalesce(F.nullif(p["answers"], F.lit("")), F.nullif(p["default"], F.lit("")))
    return F.transform(F.filter(prompts, lambda p: answer(p).isNotNull()), lambda p: F.struct(F.coalesce(p["key"], p["id"]).alias("key"), F.coalesce(p["type"], F.lit("")).alias("type"), answer(p).alias("answers")))


REVIEW = "label string, business_function string, relationship string, consolidation_action string, confidence string, consolidation_detail string, keep_report string, removable_count string, removable_member_ids array<string>"


def review(answer: Column) -> Column:
    """A reviewer's JSON answer, with or without a code fence, as a struct; ids sorted, each once."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    x = F.from_json(bare, REVIEW)
    ids = F.array_sort(F.array_distinct(F.filter(F.coalesce(x["removable_member_ids"], F.array().cast("array<string>")), lambda i: F.coalesce(i, F.lit("")) != "")))
    texts = {"label": "label", "business_function": "business_function", "relationship": "relationship", "consolidation_action": "action", "confidence": "confidence", "consolidation_detail": "detail", "keep_report": "keep_report"}
    return F.struct(*[F.coalesce(x[k], F.lit("")).alias(v) for k, v in texts.items()], F.coalesce(F.expr("0") + x["removable_count"].try_cast("double").cast("int"), F.lit(0)).alias("removable_count"), ids.alias("removable_ids"))


def slug(*parts: Column) -> Column:
    """Parts as one lower-case name with hyphens."""
    return F.btrim(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-"), F.lit("-"))


def error_class(message: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The class of the first rule (pattern, class) that a message meets, without regard to case."""
    out, low = None, F.lower(F.coalesce(message, F.lit("")))
    for pattern, name in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(other)


def named_like(x: Column, pattern: int, text: str) -> Column:
    """Search by code: 1 starts, 2 ends, 3 is, 4 contains; without regard to case."""
    low, t = F.lower(x), F.lit(text.lower())
    return {1: F.startswith(low, t), 2: F.endswith(low, t), 3: low == t, 4: F.contains(low, t)}[pattern]
