"""Queries of the scalar text functions, sources and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.sets import cosine, jaccard
from tessera.plans.catalog import query
from tessera.plans.inputs import PARTS_SQL, named_parts, read
from tessera.sources import inventory


@query("F1_norm_name", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')) AS h FROM documents")
def norm_name(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.norm_name(F.col("text")).cast("binary")).alias("h"))


@query("F2_norm_activity", "SELECT p_partkey, trim(regexp_replace(replace(lower('*' || p_name || '*x'), '*', ' '), '\\s+', ' ', 'g')) AS n FROM part")
def norm_activity(spark, d):
    return read(spark, d, "part").select("p_partkey", text.norm_activity_name(F.concat(F.lit("*"), "p_name", F.lit("*x"))).alias("n"))


@query("F3_norm_starred", "SELECT p_partkey, regexp_replace(ltrim(trim(lower('**' || p_name)), '*'), '\\s+', ' ', 'g') AS n FROM part")
def norm_starred(spark, d):
    return read(spark, d, "part").select("p_partkey", text.norm_starred_name(F.concat(F.lit("**"), "p_name")).alias("n"))


@query("F4_norm_path", f"WITH {PARTS_SQL} SELECT report_id, regexp_replace(trim(lower(path || '/'), '/'), '\\s+', ' ', 'g') AS p FROM parts")
def norm_path(spark, d):
    return named_parts(spark, d).select("report_id", text.norm_path(F.concat("path", F.lit("/"))).alias("p"))


@query("F5_norm_table", """SELECT p_partkey, list_extract(string_split(lower(trim('"SCH"."' || p_name || '"', '"')), '.'), -1) AS t FROM part""")
def norm_table(spark, d):
    return read(spark, d, "part").select("p_partkey", text.norm_table(F.concat(F.lit('"SCH"."'), "p_name", F.lit('"'))).alias("t"))


@query("F6_family_base", f"WITH {PARTS_SQL} SELECT report_id, CASE WHEN len(trim(regexp_extract(name, '(?s)^(.*) - ', 1))) >= 10 THEN trim(regexp_extract(name, '(?s)^(.*) - ', 1)) ELSE trim(name) END AS base FROM parts")
def family_base(spark, d):
    return named_parts(spark, d).select("report_id", text.family_base(F.col("name")).alias("base"))


STATEMENT = "'SELECT a, ''' || p_name || ''' FROM ZZT' || p_partkey || ' x JOIN [S].' || p_brand || ' y ON c = ' || p_size || '.5 -- note' || chr(10) || ' /* c */ WHERE pa' || p_size || ' = 1'"


def statements(spark, d):
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("SELECT a, '"), "p_name", F.lit("' FROM ZZT"), "p_partkey", F.lit(" x JOIN [S]."), "p_brand", F.lit(" y ON c = "), "p_size", F.lit(".5 -- note\n /* c */ WHERE pa"), "p_size", F.lit(" = 1")).alias("sql"))


def chained(sql, masks):
    for pattern, to in masks:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    return sql


# Written down anew for the other engine, not taken from the functions.
HASHED = chained(f"lower({STATEMENT})", [(r"--[^\n]*", ""), (r"(?s)/\*.*?\*/", ""), (r"\b[a-z0-9]{6,}zmd\d{3}\b", "ZTMP"), (r"\bzzt\w+\b", "ZTMP"), (r"\bpa\d+\b", "pa0"), ("''[^'']*''", "''?''"), (r"\b\d+(\.\d+)?\b", "0"), (r"\s+", " ")])
FOR_VECTORS = chained("lower(" + chained(STATEMENT, [(r"(?s)/\*.*?\*/", " "), ("QQ(?:QQQQ|[^QQ])*QQ".replace("Q", chr(39)), "?"), (r"--[^\n]*", " ")]) + ")", [(r"\b(zz[a-z][a-z]\d+(_\w+)?|dss_int\w*|tmp_\w+|temp_\w+)\b", "tmp_tbl"), (r"\b[a-f0-9]{16,}\b", "hashtok"), (r"\b\d+(\.\d+)?\b", "?"), (r"\s+", " ")])


@query("F8_sql_for_hash", f"SELECT p_partkey, trim({HASHED}) AS q FROM part")
def sql_for_hash(spark, d):
    return statements(spark, d).select("p_partkey", text.sql_for_hash(F.col("sql")).alias("q"))


@query("F9_sql_for_vectors", f"SELECT p_partkey, substr(trim({FOR_VECTORS}), 1, 2000) AS q FROM part")
def sql_for_vectors(spark, d):
    return statements(spark, d).select("p_partkey", text.sql_for_vectors(F.col("sql")).alias("q"))


@query("F10_sql_for_diff", "SELECT p_partkey, 'd = <DATE> and n = ''?'' MSTR=<NAME>;' || p_partkey AS q FROM part")
def sql_for_diff(spark, d):
    x = F.concat(F.lit("d = 2024-01-02 03:04:05.1 and n = '"), "p_name", F.lit("' MSTR=a "), "p_brand", F.lit(";"), "p_partkey")
    return read(spark, d, "part").select("p_partkey", text.sql_for_diff(x).alias("q"))


@query("F11_pretty_sql", "SELECT p_partkey, 'select' || chr(10) || '  ' || p_name || chr(10) || chr(10) || 'from t' AS q FROM part")
def pretty_sql(spark, d):
    return read(spark, d, "part").select("p_partkey", text.pretty_sql(F.concat(F.lit(" select \r\n\t"), "p_name", F.lit("  \n\n\n\nfrom t\n"))).alias("q"))


@query("F13_sql_blocks", "SELECT p_partkey, 2 AS n, 'select a, b from t where c = ' || p_partkey AS first_block FROM part")
def sql_blocks(spark, d):
    script = F.concat(F.lit("create table x as select a, b from t where c = "), "p_partkey", F.lit(";\ndrop table y; select 1; create temporary table z\nwith q as (select 1) select * from q"))
    return read(spark, d, "part").select("p_partkey", F.size(text.sql_blocks(script)).alias("n"), F.get(text.sql_blocks(script), F.lit(0)).alias("first_block"))


@query("F20_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) AS cosine FROM embeddings")
def cosine_of(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 9).alias("cosine"))


@query("F22_plain_text", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'a/' || p_name WHEN 3 THEN '' ELSE p_size::VARCHAR END AS t FROM part")
def plain_text(spark, d):
    name = F.concat(F.lit('"'), "p_name", F.lit('"'))
    json = F.when(F.col("p_size") % 5 == 0, name).when(F.col("p_size") % 5 == 1, F.concat(F.lit('{"id": "1", "name": '), name, F.lit("}"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit('["a", {"name": '), name, F.lit("}]"))).when(F.col("p_size") % 5 == 4, F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", text.plain(json).alias("t"))


@query("F25_labelled_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ID: ' || p_partkey ELSE 'NAME: ' || p_name || CASE WHEN p_size % 3 = 1 THEN chr(10) || 'METRICS: ' || p_brand || '; ' || p_type ELSE '' END END AS t FROM part")
def labelled_text(spark, d):
    some = F.col("p_size") % 3
    fields = {"NAME": F.when(some != 0, F.col("p_name")), "OWNER": F.lit(""), "METRICS": F.when(some == 1, text.listed(F.array("p_brand", "p_type")))}
    return read(spark, d, "part").select("p_partkey", text.labelled(fields, F.col("p_partkey")).alias("t"))


@query("F26_classify_text", "SELECT l_orderkey, 'TABLES: ' || array_to_string(list_sort(list(l_linenumber::VARCHAR))[1:3], '; ') AS t FROM lineitem GROUP BY l_orderkey")
def classify_text(spark, d):
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("string"))).alias("x"))
    return per.select("l_orderkey", text.labelled({"TABLES": text.listed(F.col("x"), 3)}, F.col("l_orderkey")).alias("t"))


@query("F27_file_name", "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || substr(p_type, 1, 2) AS t FROM part")
def file_name(spark, d):
    return read(spark, d, "part").select("p_partkey", text.file_name(F.concat(F.lit(" ."), "p_name", F.lit("//?  "), F.substring("p_type", 1, 2), F.lit("_. "))).alias("t"))


@query("F28_python_round", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2.67::DOUBLE ELSE 0.812::DOUBLE END AS x FROM customer")
def python_round(spark, d):
    even = F.col("c_custkey") % 2 == 0
    return read(spark, d, "customer").select("c_custkey", F.when(even, text.python_round(F.lit(2.675), 2)).otherwise(text.python_round(F.lit(0.8125), 3)).alias("x"))


@query("F31_prompt_answers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, p_name AS answer FROM part")
def prompt_answers(spark, d):
    row = lambda k, i, a, v: F.struct(F.lit("value").alias("type"), F.lit(k).cast("string").alias("key"), F.lit(i).alias("id"), a.cast("string").alias("answers"), v.cast("string").alias("default"))
    prompts = F.array(row("k", "1", F.lit(""), F.col("p_name")), row(None, "2", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit(None)))
    return read(spark, d, "part").select("p_partkey", F.size(text.prompt_answers(prompts)).alias("n"), text.prompt_answers(prompts)[0]["answers"].alias("answer"))


@query("F32_review_answer", "SELECT p_partkey, p_name AS label, p_size AS removable_count, '1,2' AS ids FROM part")
def review_answer(spark, d):
    json = F.concat(F.lit('```json\n{"label": "'), "p_name", F.lit('", "removable_count": "'), "p_size", F.lit('", "removable_member_ids": ["2", "1", "2"]}\n```'))
    x = text.review(json)
    return read(spark, d, "part").select("p_partkey", x["label"].alias("label"), x["removable_count"].alias("removable_count"), F.array_join(x["removable_ids"], ",").alias("ids"))


@query("F33_slug", "SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]+', '-', 'g') AS t FROM part")
def slug(spark, d):
    return read(spark, d, "part").select("p_partkey", text.slug(F.col("p_name"), F.col("p_type")).alias("t"))


@query("F7_variant_suffix", "SELECT p_partkey, p_brand AS suffix FROM part")
def variant_suffix(spark, d):
    return read(spark, d, "part").select("p_partkey", text.variant_suffix(F.concat("p_name", F.lit(" - "), "p_brand"), F.col("p_name")).alias("suffix"))


@query("F17_set_jaccard", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE WHEN p_size % 3 = 1 THEN 0.0 ELSE 1.0::DOUBLE / 3 END AS j FROM part")
def set_jaccard(spark, d):
    none = F.array().cast("array<string>")
    a = F.when(F.col("p_size") % 3 == 2, F.array(F.lit("x"), F.lit("y"))).otherwise(none)
    b = F.when(F.col("p_size") % 3 == 0, none).otherwise(F.array(F.lit("y"), F.lit("z")))
    return read(spark, d, "part").select("p_partkey", jaccard(a, b).alias("j"))


@query("F12_tables_of", "SELECT p_partkey, 'ZZT' || p_partkey || ',S.' || regexp_extract(p_brand, '[\\w.]+') AS tables FROM part")
def tables_of(spark, d):
    return statements(spark, d).select("p_partkey", F.array_join(text.tables_of(F.col("sql")), ",").alias("tables"))


@query("F15_content_hash", "SELECT doc_id, substr(sha256('model|64|' || text), 1, 32) AS h FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", text.content_hash(F.lit("model"), F.lit("64"), F.col("text"), size=32).alias("h"))


@query("F16_jitter", "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 10000 / 10000.0::DOUBLE AS x FROM customer")
def jitter(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.jitter(F.col("c_name")).alias("x"))


@query("F19_token_jaccard", "WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part) SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM t")
def token_jaccard(spark, d):
    return read(spark, d, "part").select("p_partkey", jaccard(text.name_tokens(F.col("p_name")), text.name_tokens(F.col("p_type")), 0.0).alias("j"))


@query("F21_ancestor_path", "SELECT n_nationkey, r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def ancestor_path(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    levels = F.array(F.struct((-F.lit(1)).alias("o"), F.col("n_name").alias("n")), F.struct((-F.lit(2)).alias("o"), F.col("r_name").alias("n")))
    return rows.select("n_nationkey", F.array_join(F.transform(F.array_sort(levels), lambda x: x["n"]), "/").alias("path"))


@query("F23_json_names", "SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_names(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("F24_report_blob", "SELECT doc_id, sha256(CASE WHEN len(w) <= 6000 THEN w ELSE substr(s, 1, 6000) END) AS h FROM (SELECT doc_id, 'Name: ' || source || chr(10) || 'Owner: ' || lang || chr(10) || 'Metrics: ' || n_chars AS s, 'Name: ' || source || chr(10) || 'Owner: ' || lang || chr(10) || 'Metrics: ' || n_chars || chr(10) || 'SQL: ' || text AS w FROM documents)")
def report_blob(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(text.report_blob(F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), F.col("text")), 256).alias("h"))


@query("F29_age_cutoff", "SELECT o_orderkey, (o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 540 DAY) AS retire FROM orders")
def age_cutoff(spark, d):
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate").isNull() | (F.col("o_orderdate") < F.expr("TIMESTAMP '1998-01-01' - INTERVAL 540 DAY"))).alias("retire"))


@query("F30_min_max_scale", "SELECT c_custkey, (c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) - min(c_acctbal) FROM customer)) AS x FROM customer")
def min_max_scale(spark, d):
    c = read(spark, d, "customer")
    ends = c.agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    span = F.col("high") - F.col("low")
    return c.join(F.broadcast(ends)).select("c_custkey", ((F.col("c_acctbal") - F.col("low")) / F.when(span == 0, 1.0).otherwise(span)).alias("x"))


@query("P20_location", f"WITH {PARTS_SQL} SELECT CASE WHEN report_id % 3 = 0 THEN 'Personal' WHEN report_id % 3 = 1 THEN 'Public' ELSE 'Other' END AS place, count(*) AS n FROM parts GROUP BY 1")
def location(spark, d):
    path = F.when(F.col("report_id") % 3 == 0, F.lit("/a/Profiles/u")).when(F.col("report_id") % 3 == 1, F.col("path")).otherwise(F.lit("/x"))
    return named_parts(spark, d).groupBy(text.location(path).alias("place")).agg(F.count("*").alias("n"))


@query("P7_substring_any", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%11%' OR lower(c_name) LIKE '%47%'")
def substring_any(spark, d):
    marks = F.array(F.lit("11"), F.lit("47"))
    return read(spark, d, "customer").where(F.exists(marks, lambda x: F.contains(F.lower("c_name"), x))).select("c_custkey")


@query("P19_pattern_search", "SELECT p_partkey, lower(p_name) LIKE 'red%' AS starts, lower(p_name) LIKE '%ring' AS ends, lower(p_name) = 'red ring' AS same, lower(p_name) LIKE '%d r%' AS inside FROM part")
def pattern_search(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", *[text.named_like(n, i, t).alias(a) for i, (t, a) in enumerate([("RED", "starts"), ("ring", "ends"), ("Red Ring", "same"), ("d R", "inside")], 1)])


@query("P22_error_class", "SELECT event_type, CASE WHEN lower(event_type) LIKE '%click%' THEN 'prompt' WHEN lower(event_type) LIKE '%i%' THEN 'timeout' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def error_class(spark, d):
    return read(spark, d, "events").groupBy("event_type", text.error_class(F.col("event_type"), [("click", "prompt"), ("i", "timeout")]).alias("class")).agg(F.count("*").alias("n"))


@query("S2_record_shredder", "SELECT l_orderkey AS report_id, p_brand AS name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def record_shredder(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    records = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("name"))).alias("metrics"))
    return inventory.shred(records, "metrics").groupBy("report_id", "name").agg(F.count("*").alias("n"))


@query("S4_enrichment_merge", "SELECT coalesce(p_partkey, s_suppkey) AS id, coalesce(s_name, p_name) AS name FROM part FULL JOIN supplier ON s_suppkey = p_partkey")
def enrichment_merge(spark, d):
    old = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return inventory.upsert(old, new, ["id"])


@query("S6_object_counts", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1")
def object_counts(spark, d):
    counts = read(spark, d, "customer").groupBy("c_mktsegment").count()
    as_map = counts.agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "count"))).alias("byCategory"))
    return as_map.select(F.explode("byCategory").alias("category", "n"))


@query("S16_work_list", "SELECT o_orderkey AS report_id FROM orders WHERE o_totalprice > 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def work_list(spark, d):
    tele = read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_totalprice").alias("execs"))
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_returnflag") == "R", "select").alias("sql"))
    return inventory.without_statement(tele.where("execs > 0"), line)


@query("S17_cube_work_list", "SELECT p_partkey AS report_id, n AS execs FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_type = 'ECONOMY' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def cube_work_list(spark, d):
    reports = read(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("report_id"))
    line = read(spark, d, "lineitem").select(F.col("l_partkey").alias("report_id"), "l_returnflag", "l_linenumber")
    tele = line.groupBy("report_id").agg(F.count("*").alias("execs"))
    return inventory.without_features(reports, line.where("l_returnflag = 'R' AND l_linenumber = 1"), tele, unused=True)


@query("S15_pass_join", "SELECT conv_id, sha256(string_agg(text, chr(10) || '-- pass --' || chr(10) ORDER BY turn)) AS h, count(*) AS passes FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id")
def pass_join(spark, d):
    rows = read(spark, d, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), "\n-- pass --\n"), 256).alias("h"), F.size("p").cast("long").alias("passes"))
