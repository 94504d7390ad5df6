"""Queries of the whole funnel, its emitted tables, syntax shapes and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import funnel, syntax, usage, vectors, views
from tessera.plans import emit
from tessera.plans.catalog import query
from tessera.plans.inputs import SETS_SQL, read
from tessera.storage import materialize


def inputs(spark, d):
    """Customers as reports: their batch, name and use; priorities, states and years of their orders as features; a statement each, and shapes of every second."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    batch = F.element_at(F.array(*map(F.lit, ["original", "new", "added", "old"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    inventory = c.select(F.col("c_custkey").alias("report_id"), batch.alias("batch"), F.concat("c_mktsegment", F.lit(" margin report "), F.col("c_custkey") % 8, F.lit(" - "), F.col("c_custkey") % 3).alias("name"), F.concat(F.lit("/Public/"), "c_nationkey").alias("path"))
    telemetry = c.select(F.col("c_custkey").alias("report_id"), F.pmod(F.floor("c_acctbal"), F.lit(40)).cast("long").alias("execs"), F.col("c_nationkey").cast("string").alias("last"), F.when(F.col("c_custkey") % 3 == 0, "exact").when(F.col("c_nationkey") % 5 == 0, "fuzzy").otherwise("exact_id").alias("tier"))
    features = o.select(F.col("o_custkey").alias("report_id"), F.col("o_orderpriority").alias("m"), F.col("o_orderstatus").alias("t"), F.year("o_orderdate").cast("string").alias("f"))
    statements = c.select(F.col("c_custkey").alias("report_id"), F.concat(F.lit("SELECT a"), F.col("c_nationkey") % 7, F.lit(" FROM t WHERE b = '"), "c_custkey", F.lit("' AND c"), F.col("c_custkey") % 29, F.lit(" = 1 -- x")).alias("sql"))
    hashes = o.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("report_id")).agg(F.collect_set(F.concat_ws("/", "o_orderpriority", "o_orderstatus")).alias("hashes"))
    return inventory, features, telemetry, statements, hashes


def run(spark, d, mode="reference", last=None):
    return funnel.run_pipeline(*inputs(spark, d), mode=mode, last=last)


RUN_SQL = """inv AS (SELECT c_custkey AS report_id, c_custkey % 4 AS batch, c_mktsegment || ' margin report ' || (c_custkey % 8) || ' - ' || (c_custkey % 3) AS name FROM customer),
tele AS (SELECT c_custkey AS report_id, (((floor(c_acctbal)::BIGINT % 40) + 40) % 40) AS execs, c_nationkey::VARCHAR AS last, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS inexact, c_custkey % 3 > 0 AND c_nationkey % 5 = 0 AS fuzzy FROM customer),
universe AS (SELECT * FROM inv JOIN tele USING (report_id) WHERE batch < 3 AND execs > 0),
c1 AS (SELECT execs, last, first(report_id ORDER BY inexact, len(name), report_id) AS c FROM universe GROUP BY execs, last HAVING count(*) >= 2 AND (count(DISTINCT lower(name)) = 1 OR (count(*) >= 3 AND bool_or(fuzzy)))),
m1 AS (SELECT u.*, c1.c FROM universe u LEFT JOIN c1 USING (execs, last)),
c2 AS (SELECT lower(name) AS n, execs, first(report_id ORDER BY inexact, report_id) AS c2 FROM m1 WHERE c IS NULL OR c = report_id GROUP BY 1, 2 HAVING count(*) >= 2),
collision AS (SELECT report_id, CASE WHEN c IS NOT NULL AND c <> report_id THEN c WHEN c2 IS NOT NULL THEN c2 ELSE report_id END AS canonical_id FROM m1 LEFT JOIN c2 ON c2.n = lower(m1.name) AND c2.execs = m1.execs),
k1 AS (SELECT * FROM universe WHERE report_id NOT IN (SELECT report_id FROM collision WHERE report_id <> canonical_id)),
fsets AS (SELECT o_custkey AS report_id, list_sort(list_distinct(list(lower(o_orderpriority)))) AS m, list_sort(list_distinct(list(lower(o_orderstatus)))) AS t, list_sort(list_distinct(list(year(o_orderdate)::VARCHAR))) AS f FROM orders GROUP BY o_custkey),
fg AS (SELECT m, t, f, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM k1 JOIN fsets USING (report_id) WHERE len(m) + len(t) + len(f) >= 3 GROUP BY m, t, f HAVING count(*) >= 2),
fingerprint AS (SELECT k1.report_id, canonical_id FROM k1 JOIN fsets USING (report_id) JOIN fg USING (m, t, f)),
k2 AS (SELECT * FROM k1 WHERE report_id NOT IN (SELECT report_id FROM fingerprint WHERE report_id <> canonical_id)),
hashes AS (SELECT c_custkey AS report_id, (c_nationkey % 7) || '/' || (c_custkey % 29) AS h FROM customer),
hg AS (SELECT h, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM k1 JOIN hashes USING (report_id) GROUP BY h HAVING count(*) >= 2),
sql_hash AS (SELECT k1.report_id, canonical_id FROM k1 JOIN hashes USING (report_id) JOIN hg USING (h)),
k3 AS (SELECT * FROM k2 WHERE report_id NOT IN (SELECT report_id FROM sql_hash WHERE report_id <> canonical_id)),
hset AS (SELECT o_custkey AS report_id, list_sort(list_distinct(list(o_orderpriority || '/' || o_orderstatus))) AS x FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey),
aset AS (SELECT report_id, execs, x FROM k3 JOIN hset USING (report_id)),
ahit AS (SELECT a.report_id AS a, b.report_id AS b FROM aset a JOIN aset b ON a.report_id < b.report_id AND len(list_intersect(a.x, b.x))::DOUBLE / len(list_distinct(list_concat(a.x, b.x))) >= 0.8::DOUBLE),
ae AS (SELECT a AS u, b AS v FROM ahit UNION SELECT b, a FROM ahit),
areach AS (SELECT u AS node, u AS seen FROM ae UNION SELECT areach.node, ae.v FROM areach JOIN ae ON ae.u = areach.seen),
acomp AS (SELECT node, min(seen) AS component FROM areach GROUP BY node),
abest AS (SELECT component, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM acomp JOIN k3 ON report_id = node GROUP BY component),
ast AS (SELECT node AS report_id, canonical_id FROM acomp JOIN abest USING (component)),
k3a AS (SELECT * FROM k3 WHERE report_id NOT IN (SELECT report_id FROM ast WHERE report_id <> canonical_id)),
bases AS (SELECT *, lower(regexp_extract(name, '(?s)^(.*) - ', 1)) AS base FROM k3a),
famg AS (SELECT base, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM bases GROUP BY base HAVING count(*) >= 2),
family AS (SELECT report_id, canonical_id FROM bases JOIN famg USING (base)),
k4 AS (SELECT * FROM k3a WHERE report_id NOT IN (SELECT report_id FROM family WHERE report_id <> canonical_id)),
known AS (SELECT k4.*, m, t, f, coalesce(x, []) AS x FROM k4 JOIN fsets USING (report_id) LEFT JOIN hset USING (report_id)),
sims AS (SELECT a.report_id AS a, b.report_id AS b, len(a.x) > 0 AND len(b.x) > 0 AS shaped, len(list_intersect(a.m, b.m))::DOUBLE / len(list_distinct(list_concat(a.m, b.m))) AS m, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS t, len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(list_concat(a.f, b.f))) AS f, len(list_intersect(a.x, b.x))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.x, b.x)))) AS x FROM known a JOIN known b ON a.report_id < b.report_id),
jac AS (SELECT a, b, CASE WHEN shaped THEN 0.6::DOUBLE * x + 0.25::DOUBLE * m + 0.15::DOUBLE * t ELSE 0.4::DOUBLE * m + 0.4::DOUBLE * t + 0.2::DOUBLE * f END AS score FROM sims),
e AS (SELECT a AS u, b AS v FROM jac WHERE score >= 0.8::DOUBLE UNION SELECT b, a FROM jac WHERE score >= 0.8::DOUBLE),
reach AS (SELECT u AS node, u AS seen FROM e UNION SELECT reach.node, e.v FROM reach JOIN e ON e.u = reach.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
best AS (SELECT component, first(report_id ORDER BY execs DESC, report_id) AS canonical_id FROM comp JOIN k4 ON report_id = node GROUP BY component),
similarity AS (SELECT node AS report_id, canonical_id FROM comp JOIN best USING (component)),
final AS (SELECT report_id FROM k4 WHERE report_id NOT IN (SELECT report_id FROM similarity) UNION SELECT canonical_id FROM similarity),
counts AS (SELECT 1 AS ordinal, 'inventory' AS stage, (SELECT count(*) FROM inv) AS remaining UNION ALL SELECT 2, 'universe', (SELECT count(*) FROM universe) UNION ALL SELECT 3, 'collision', (SELECT count(*) FROM k1) UNION ALL SELECT 4, 'fingerprint', (SELECT count(*) FROM k2)
  UNION ALL SELECT 5, 'sql_hash', (SELECT count(*) FROM k3) UNION ALL SELECT 6, 'ast', (SELECT count(*) FROM k3a) UNION ALL SELECT 7, 'family', (SELECT count(*) FROM k4) UNION ALL SELECT 8, 'similarity', (SELECT count(*) FROM k4 WHERE report_id NOT IN (SELECT report_id FROM similarity WHERE report_id <> canonical_id)) UNION ALL SELECT 9, 'final', (SELECT count(*) FROM final)),
stages AS (SELECT 1 AS o, 'collision' AS stage, * FROM collision UNION ALL SELECT 2, 'fingerprint', * FROM fingerprint UNION ALL SELECT 3, 'sql_hash', * FROM sql_hash UNION ALL SELECT 4, 'ast', * FROM ast UNION ALL SELECT 5, 'family', * FROM family UNION ALL SELECT 6, 'similarity', * FROM similarity),
s0 AS (SELECT inv.report_id, u.report_id AS s, CASE WHEN u.report_id IS NULL THEN 'telemetry' END AS stage FROM inv LEFT JOIN universe u USING (report_id))"""
for _i, _n in enumerate(funnel.STAGES):
    RUN_SQL += f",\ns{_i + 1} AS (SELECT s{_i}.report_id, coalesce(x.canonical_id, s) AS s, coalesce(stage, CASE WHEN x.canonical_id IS NOT NULL THEN '{_n}' END) AS stage FROM s{_i} LEFT JOIN {_n} x ON x.report_id = s AND x.canonical_id <> s)"


@query("P1_active_universe", f"WITH RECURSIVE {RUN_SQL} SELECT report_id, name, execs FROM universe")
def universe(spark, d):
    inventory, _, telemetry, *_ = inputs(spark, d)
    return funnel.active_universe(inventory, telemetry, funnel.BATCHES, "name").select("report_id", "name", "execs")


@query("P2_scope", f"WITH RECURSIVE {RUN_SQL} SELECT 'post-collision' AS scope, report_id FROM k1 UNION ALL SELECT 'post-ast', report_id FROM k3a UNION ALL SELECT 'post-family', report_id FROM k4 UNION ALL SELECT 'active', report_id FROM universe UNION ALL SELECT 'final-kept', report_id FROM final")
def scopes(spark, d):
    from functools import reduce

    result = run(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [funnel.scope(result, n).select(F.lit(n).alias("scope"), "report_id") for n in ("post-collision", "post-ast", "post-family", "active", "final-kept")])


@query("P3_source_filter", "SELECT p_partkey AS report_id FROM part WHERE p_type <> 'ECONOMY'")
def source_filter(spark, d):
    reports = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.when(F.col("p_type") == "ECONOMY", "cube").otherwise("normal").alias("source_type"))
    return funnel.of_source(reports, reports.select("report_id"), "exclude-cube")


@query("P4_domain_filter", "SELECT vec_id AS report_id FROM embeddings WHERE label = 1")
def domain_filter(spark, d):
    e = read(spark, d, "embeddings").withColumnRenamed("vec_id", "report_id")
    return e.select("report_id").join(e.where("label = 1").select("report_id"), "report_id", "left_semi")


@query("D11_funnel", f"WITH RECURSIVE {RUN_SQL} SELECT ordinal, stage, remaining, coalesce(lag(remaining) OVER w - remaining, 0) AS removed, 100.0::DOUBLE * remaining / first_value(remaining) OVER w AS percent, 100.0::DOUBLE * remaining / coalesce(lag(remaining) OVER w, remaining) AS percent_of_previous FROM counts WINDOW w AS (ORDER BY ordinal)")
def funnel_steps(spark, d):
    return usage.stage_steps(run(spark, d).counts())


@query("D16_survivor_chain", f"WITH RECURSIVE {RUN_SQL} SELECT report_id, coalesce(s, -1) AS survivor_id, stage FROM s6")
def survivor_chain(spark, d):
    return run(spark, d).survivors().withColumn("survivor_id", F.coalesce("survivor_id", F.lit(-1)))


@query("D17_outcomes", f"WITH RECURSIVE {RUN_SQL}, before AS (SELECT 1 AS o, report_id FROM universe UNION ALL SELECT 2, report_id FROM k1 UNION ALL SELECT 3, report_id FROM k2 UNION ALL SELECT 4, report_id FROM k3 UNION ALL SELECT 5, report_id FROM k3a UNION ALL SELECT 6, report_id FROM k4) SELECT b.report_id, ['collision', 'fingerprint', 'sql_hash', 'ast', 'family', 'similarity'][o] AS stage, CASE WHEN x.canonical_id IS NULL THEN 'kept' WHEN x.canonical_id = b.report_id THEN 'primary' ELSE 'collapsed' END AS outcome FROM before b LEFT JOIN stages x USING (o, report_id) UNION ALL SELECT report_id, 'telemetry', 'retired' FROM s0 WHERE s IS NULL")
def outcomes(spark, d):
    return run(spark, d).outcomes()


@query("A39_stage_summary", f"WITH RECURSIVE {RUN_SQL}, before AS (SELECT 1 AS o, report_id FROM universe UNION ALL SELECT 2, report_id FROM k1 UNION ALL SELECT 3, report_id FROM k2 UNION ALL SELECT 4, report_id FROM k3 UNION ALL SELECT 5, report_id FROM k3a UNION ALL SELECT 6, report_id FROM k4) SELECT ['collision', 'fingerprint', 'sql_hash', 'ast', 'family', 'similarity'][o] AS stage, count(*) AS input, count(*) FILTER (WHERE x.canonical_id IS NULL OR x.canonical_id = b.report_id) AS kept, count(*) FILTER (WHERE x.canonical_id <> b.report_id) AS collapsed FROM before b LEFT JOIN stages x USING (o, report_id) GROUP BY o")
def stage_summary(spark, d):
    rows = run(spark, d).outcomes().where("stage <> 'telemetry'")
    return rows.groupBy("stage").agg(F.count("*").alias("input"), F.count_if(F.col("outcome") != "collapsed").alias("kept"), F.count_if(F.col("outcome") == "collapsed").alias("collapsed"))


@query("D18_why", f"WITH RECURSIVE {RUN_SQL} SELECT report_id, CASE WHEN c_nationkey = 3 THEN 'retained by a user' WHEN c_nationkey = 4 THEN 'retired by a user' WHEN stage = 'telemetry' THEN 'not used' WHEN stage IS NOT NULL THEN 'collapsed by ' || stage ELSE 'kept' END AS why FROM s6 JOIN customer ON c_custkey = report_id")
def why(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "report_id")
    return funnel.why(run(spark, d), c.where("c_nationkey = 3"), c.where("c_nationkey = 4"))


@query("U3_after_hash", f"WITH RECURSIVE {RUN_SQL} SELECT report_id FROM k3")
def after_hash(spark, d):
    return run(spark, d).kept["sql_hash"].select("report_id")


@query("U4_after_ast", f"WITH RECURSIVE {RUN_SQL} SELECT report_id FROM k3a")
def after_ast(spark, d):
    return run(spark, d).kept["ast"].select("report_id")


@query("U5_after_family", f"WITH RECURSIVE {RUN_SQL} SELECT report_id FROM k4")
def after_family(spark, d):
    return run(spark, d).kept["family"].select("report_id")


@query("A14_funnel_scalars", f"WITH RECURSIVE {RUN_SQL} SELECT (SELECT count(*) FROM inv) AS inventory, (SELECT count(*) FROM universe) AS active, (SELECT count(*) FROM final) AS final, round(100.0::DOUBLE * (1 - (SELECT count(*) FROM final) / (SELECT count(*) FROM universe)::DOUBLE), 1) AS reduction")
def funnel_scalars(spark, d):
    n = run(spark, d).counts().groupBy().pivot("stage", ["inventory", "universe", "final"]).agg(F.first("remaining"))
    return n.select("inventory", F.col("universe").alias("active"), "final", F.round(F.lit(100.0) * (1 - F.col("final") / F.col("universe")), 1).alias("reduction"))


@query("A48_reductions", f"WITH RECURSIVE {RUN_SQL} SELECT stage, lag(remaining) OVER (ORDER BY ordinal) - remaining AS removed FROM counts QUALIFY removed > 0")
def reductions(spark, d):
    return usage.stage_steps(run(spark, d).counts()).where("removed > 0").select("stage", "removed")


@query("D10_reports", f"WITH RECURSIVE {RUN_SQL} SELECT inv.report_id, inv.name, CASE WHEN s6.stage = 'telemetry' THEN 'retired' WHEN s6.stage IS NOT NULL THEN 'collapsed' ELSE 'active' END AS status, coalesce(len(m), 0) AS n_m, coalesce(len(t), 0) AS n_t, coalesce(len(f), 0) AS n_f, coalesce(s6.s, -1) AS survivor_id FROM inv JOIN s6 USING (report_id) LEFT JOIN fsets USING (report_id)")
def reports(spark, d):
    inventory, features, *_ = inputs(spark, d)
    return emit.reports(run(spark, d), features).select("report_id", "name", "status", "n_m", "n_t", "n_f", F.coalesce("survivor_id", F.lit(-1)).alias("survivor_id"))


@query("E1_summary", f"WITH RECURSIVE {RUN_SQL} SELECT stage, remaining FROM counts")
def summary(spark, d):
    return run(spark, d).counts().drop("ordinal")


@query("E3_inventory_all", f"WITH RECURSIVE {RUN_SQL} SELECT report_id, name, coalesce(execs, 0) AS execs, execs IS NOT NULL AS active FROM inv LEFT JOIN (SELECT report_id, execs FROM universe) u USING (report_id)")
def inventory_all(spark, d):
    return emit.inventory_all(run(spark, d, last="universe")).select("report_id", "name", F.coalesce("execs", F.lit(0)).alias("execs"), "active")


@query("E4_retired", f"WITH RECURSIVE {RUN_SQL} SELECT report_id, name, CASE WHEN batch = 3 THEN 'batch' ELSE 'telemetry' END AS bucket FROM inv WHERE report_id NOT IN (SELECT report_id FROM universe)")
def retired(spark, d):
    return emit.retired(run(spark, d), ["old"]).select("report_id", "name", "bucket")


def group_sql(stage: str, kept: str) -> str:
    return f"WITH RECURSIVE {RUN_SQL}, g AS (SELECT canonical_id, list_sort(list(report_id)) AS ids, count(*) AS size FROM {stage} GROUP BY canonical_id HAVING count(*) >= 2) SELECT canonical_id, array_to_string(ids, ',') AS members, size, size - 1 AS reducible, (SELECT sum(execs)::BIGINT FROM universe u WHERE list_contains(ids, u.report_id)) AS execs FROM g"


def groups(stage):
    def build(spark, d):
        result = run(spark, d, last="family" if stage == "family" else None)
        return emit.groups(result, stage).select("canonical_id", F.array_join(F.array_sort(F.transform("members", lambda m: m["report_id"])), ",").alias("members"), "size", "reducible", "execs")

    return build


for _id, _stage, _kept in (("E5_collisions", "collision", "k1"), ("E6_fingerprints", "fingerprint", "k2"), ("E7_sql_hash_groups", "sql_hash", "k3"), ("E8_ast_clusters", "ast", "k3a"), ("E10_families", "family", "k4"), ("E11_clusters", "similarity", "final")):
    query(_id, group_sql(_stage, _kept))(groups(_stage))


@query("E12_similarities", f"WITH RECURSIVE {RUN_SQL} SELECT a, b, round(score, 9) AS score FROM jac WHERE score >= 0.8::DOUBLE")
def similarities(spark, d):
    result = run(spark, d)
    return emit.similarities(result).select("a", "b", F.round("score", 9).alias("score"))


HASHES_SQL = f"{SETS_SQL}, h AS (SELECT report_id, list_sort(list_distinct(list_concat(m, t))) AS s FROM sets), x AS (SELECT min(report_id) AS id, s, count(*) AS n FROM h GROUP BY s), k AS (SELECT id, unnest(s) AS e, len(s) AS n FROM x)"


def feature_hashes(spark, d):
    from tessera.operators import dedup
    from tessera.plans.inputs import features

    return dedup.feature_sets(features(spark, d)).select("report_id", F.array_union("m", "t").alias("hashes"))


@query("D7_ast", f"""WITH RECURSIVE {HASHES_SQL}, c AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM k a JOIN k b ON a.e = b.e AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY a.id, b.id),
hits AS (SELECT a, b FROM c WHERE shared::DOUBLE / (na + nb - shared) >= 0.8::DOUBLE), e AS (SELECT a AS u, b AS v FROM hits UNION SELECT b, a FROM hits), reach AS (SELECT u AS node, u AS seen FROM e UNION SELECT reach.node, e.v FROM reach JOIN e ON e.u = reach.seen), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT h.report_id, coalesce(component, x.id) AS component FROM h JOIN x USING (s) LEFT JOIN comp ON node = x.id WHERE component IS NOT NULL OR x.n > 1""")
def ast_groups(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.floor("o_totalprice").cast("long").alias("execs"))
    return funnel.by_syntax(rows, feature_hashes(spark, d))[0].select("report_id", "component")


@query("A10_pair_statistics", f"WITH {HASHES_SQL}, q AS (SELECT report_id, report_id % 500 AS component, s FROM h), p AS (SELECT a.component, len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM q a JOIN q b ON a.component = b.component AND a.report_id < b.report_id) SELECT component, size, round(avg(j), 6) AS mean, round(min(j), 6) AS least, sets = 1 AS all_exact FROM p JOIN (SELECT component, count(*) AS size, count(DISTINCT s) AS sets FROM q GROUP BY component) USING (component) GROUP BY component, size, sets")
def pair_statistics(spark, d):
    members = feature_hashes(spark, d).withColumn("component", F.col("report_id") % 500)
    return syntax.pair_statistics(members).select("component", "size", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), "all_exact")


@query("A28_exact_groups", f"WITH {HASHES_SQL} SELECT sum(n)::BIGINT AS parsed, count(*) FILTER (WHERE n > 1) AS groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS in_groups, coalesce(sum(n - 1) FILTER (WHERE n > 1), 0)::BIGINT AS removable FROM x")
def exact_groups(spark, d):
    return syntax.exact_groups(feature_hashes(spark, d))


@query("G16_ast_hashes", "SELECT c_custkey AS report_id, 'a' || (c_nationkey % 7) || ',c' || (c_custkey % 29) AS shape, 12 AS hashes FROM customer")
def ast_hashes(spark, d):
    statements = inputs(spark, d)[3]
    named = statements.select("report_id", F.concat_ws(",", F.regexp_extract("sql", "SELECT (a[0-9]+)", 1), F.regexp_extract("sql", "(c[0-9]+) = 1", 1)).alias("shape"))
    hashed = syntax.hash_statements(statements)
    return hashed.join(named, "report_id").select("report_id", "shape", F.size("hashes").alias("hashes"))


@query("J11_cache_probe", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 3 = 0) AS cached, count(*) FILTER (WHERE doc_id % 3 <> 0) AS new FROM documents")
def cache_probe(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.coalesce("text", F.lit("")).alias("text"))
    cache = vectors.keyed(texts, "terms", 16).where("report_id % 3 = 0").select("report_id", "model", "content_hash")
    return vectors.probe(texts, cache, "terms", 16).select("total", "cached", "new")


@query("G13_embedded", "SELECT doc_id AS report_id, 'terms' AS model, 16 AS dim FROM documents")
def embedded(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = spark.createDataFrame([], "report_id long, model string, content_hash string, vector array<float>")
    return vectors.embedded(texts, none, "terms", 16).select("report_id", "model", F.size("vector").alias("dim"))


@query("G12_domains", "SELECT p_partkey AS report_id, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_type = 'PROMO' THEN 'offer' ELSE 'Other' END AS domain FROM part")
def classified(spark, d):
    texts = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_type").alias("text"))
    return vectors.classified(texts, {"cheap": ["economy"], "offer": ["promo"]}).select("report_id", "domain")


@query("G5_reattached", "SELECT label AS cluster_id, 'review ' || label AS review FROM embeddings GROUP BY label")
def reattached(spark, d):
    e = read(spark, d, "embeddings").groupBy("label").agg(F.collect_list("vec_id").alias("members"))
    reviews = e.select(F.reverse(F.array_sort("members")).alias("members"), F.concat(F.lit("review "), "label").alias("review"))
    return vectors.reattached(e.withColumnRenamed("label", "cluster_id"), reviews).select("cluster_id", "review")


@query("G6_projection")
def projection(spark, d):
    return vectors.projected(read(spark, d, "embeddings"), "vec_id", "embedding").select("id", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("G8_density")
def density(spark, d):
    e = read(spark, d, "embeddings")
    points = vectors.projected(e, "vec_id", "embedding", 5).withColumn("part", F.lit("all"))
    return vectors.dense(points, [f"x{i}" for i in range(5)], "part")


@query("G9_silhouette", """WITH p AS (SELECT c_custkey AS id, c_nationkey AS c, c_acctbal / 1000 AS x FROM customer WHERE c_nationkey <> 3), d AS (SELECT a.id, a.c AS own, b.c, sum(abs(a.x - b.x)) AS total, count(*) AS n FROM p a, p b GROUP BY ALL),
s AS (SELECT id, sum(CASE WHEN own = c AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN own <> c THEN total / n END) AS b FROM d GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") == 3, -1).otherwise(F.col("c_nationkey")).alias("cluster"), (F.col("c_acctbal") / 1000).alias("x"))
    return vectors.silhouette(c, ["x"]).select(F.round("silhouette", 6).alias("silhouette"))


@query("G10_linkage")
def linkage(spark, d):
    return vectors.linked(read(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


@query("G20_compare", f"WITH {SETS_SQL}, x AS (SELECT a.report_id, a.m AS am, b.m AS bm, a.t AS a_t, b.t AS b_t, a.f AS af, b.f AS bf FROM sets a JOIN sets b ON b.report_id = a.report_id + 1), j AS (SELECT report_id, len(list_intersect(am, bm))::DOUBLE / len(list_distinct(list_concat(am, bm))) AS m, len(list_intersect(a_t, b_t))::DOUBLE / len(list_distinct(list_concat(a_t, b_t))) AS t, len(list_intersect(af, bf))::DOUBLE / len(list_distinct(list_concat(af, bf))) AS f FROM x) SELECT report_id, round(100 * (0.4::DOUBLE * m + 0.4::DOUBLE * t + 0.2::DOUBLE * f), 6) AS overall, concat_ws(';', CASE WHEN m = 1 THEN 'all metrics' WHEN m >= 0.75 THEN 'most metrics' END, CASE WHEN t = 1 THEN 'all tables' WHEN t >= 0.75 THEN 'most tables' END, CASE WHEN f = 1 THEN 'all filters' WHEN f >= 0.75 THEN 'most filters' END) AS reasons FROM j")
def compare(spark, d):
    from tessera.operators import dedup
    from tessera.plans.inputs import features

    s = dedup.feature_sets(features(spark, d))
    pairs = s.join(s.select((F.col("report_id") - 1).alias("report_id"), F.col("m").alias("m2"), F.col("t").alias("t2"), F.col("f").alias("f2")), "report_id")
    return emit.compared(pairs).select("report_id", F.round("overall", 6).alias("overall"), "reasons")


@query("E14_semantic_clusters", "SELECT label AS cluster_id, count(*) AS size, first(vec_id ORDER BY vec_id DESC) AS primary_id, min(vec_id) AS last_id FROM embeddings GROUP BY label")
def semantic_clusters(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("report_id"), F.col("vec_id").alias("execs"))
    best = rows.groupBy("cluster_id").agg(F.max("report_id").alias("primary"))
    placed = views.ordered_members(rows.join(best, "cluster_id"), "cluster_id", "primary")
    return placed.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min_by("report_id", "place").alias("primary_id"), F.max_by("report_id", "place").alias("last_id"))


@query("T8_member_sample", "SELECT label, count(*) AS n, CASE WHEN count(*) > 25 THEN '+' || (count(*) - 25) || ' more' END AS last FROM embeddings GROUP BY label")
def member_sample(spark, d):
    rows = read(spark, d, "embeddings").select("label", F.col("vec_id").alias("report_id"), F.col("vec_id").cast("string").alias("name"), F.lit(1).alias("execs"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    lines = views.sampled_members(rows, "label").select("label", F.when(F.size("lines") > 25, F.element_at("lines", -1)).alias("last"))
    return n.join(lines, "label")


@query("W5_top_unique_names", "SELECT lower(p_name) AS key, max(p_size) AS execs, first(p_partkey ORDER BY p_size DESC, p_partkey) AS report_id FROM part GROUP BY 1 ORDER BY execs DESC, report_id LIMIT 15")
def top_unique_names(spark, d):
    return views.top_unique_names(read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("name"), F.col("p_size").alias("execs")))


@query("J20_latest_domains", "SELECT user_id AS report_id, first(event_type ORDER BY ts DESC, event_type DESC) AS domain, max(ts) AS at FROM events GROUP BY user_id")
def latest_domains(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("report_id"), F.col("event_type").alias("domain"), F.col("value").alias("confidence"), F.col("ts").alias("at"))
    return views.latest_domains(rows).select("report_id", "domain", "at")


@query("J12_unnest", "SELECT l_orderkey, p_brand AS feature, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def unnest(spark, d):
    from tessera.plans.inputs import features

    json = features(spark, d).groupBy(F.col("report_id").alias("l_orderkey")).agg(F.to_json(F.collect_list("m")).alias("metrics_json"))
    return json.select("l_orderkey", F.explode(F.from_json("metrics_json", "array<string>")).alias("feature")).groupBy("l_orderkey", "feature").agg(F.count("*").alias("n"))


@query("A20_nested_arrays", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS m, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS t FROM orders GROUP BY o_custkey")
def nested_arrays(spark, d):
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_set("o_orderpriority")).alias("m"), F.array_sort(F.collect_set("o_orderstatus")).alias("t"))).alias("j"))
    x = F.from_json("j", "m array<string>, t array<string>")
    return per.select("o_custkey", F.array_join(x["m"], ",").alias("m"), F.array_join(x["t"], ",").alias("t"))


@query("A13_users", "SELECT p_brand AS cluster, count(*) FILTER (WHERE p_size % 13 > 0) AS members_with_users, sum(p_size % 13)::BIGINT AS users FROM part GROUP BY p_brand")
def cluster_users(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("cluster"), (F.col("p_size") % 13).alias("users"))
    return p.groupBy("cluster").agg(F.count_if(F.col("users") > 0).alias("members_with_users"), F.sum("users").alias("users"))


@query("A40_width", "SELECT round(quantile_cont(len(p_name), 0.95), 6) AS width FROM part")
def width(spark, d):
    return read(spark, d, "part").agg(F.round(F.percentile(F.length("p_name"), F.lit(0.95)), 6).alias("width"))


@query("J5_family_siblings", "WITH g AS (SELECT p_brand, first(p_partkey ORDER BY p_size DESC, p_partkey) AS canonical_id FROM part GROUP BY p_brand) SELECT p_partkey AS report_id, canonical_id, row_number() OVER (PARTITION BY canonical_id ORDER BY p_size DESC, p_name, p_partkey) AS place FROM part JOIN g USING (p_brand) WHERE p_partkey <> canonical_id")
def family_siblings(spark, d):
    from tessera.operators import dedup

    rows = read(spark, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_size").alias("execs"), "p_brand", "p_name")
    gone = dedup.collapsed(dedup.groups_by(rows, [F.col("p_brand")])).select("report_id", "canonical_id")
    named = gone.join(rows, "report_id")
    order = Window.partitionBy("canonical_id").orderBy(F.desc("execs"), "p_name", "report_id")
    return named.select("report_id", "canonical_id", F.row_number().over(order).cast("long").alias("place"))
