"""Matching of an inventory to activity records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import name_tokens, norm_activity_name, norm_path, norm_starred_name
from tessera.storage import materialize


def waterfall(inventory: DataFrame, activity: DataFrame) -> DataFrame:
    """``report_id``, ``tier``, ``execs`` for inventory (report_id, name, path) and activity (object_id, name, path, execs).

    Ids first; then name and path, then name alone if there is one, each activity
    record being taken once, by the least report id, the most executed record
    first.  Asterisks in names are spaces, leading slashes of paths do not count.
    """

    def keyed(rows):
        return rows.withColumn("norm", norm_activity_name(F.coalesce("name", F.lit("")))).withColumn("path", F.ltrim(F.coalesce("path", F.lit("")), F.lit("/")))

    inv, act = keyed(inventory), materialize(keyed(activity), "activity")
    by_id = inv.join(act.select(F.col("object_id").alias("report_id"), "execs"), "report_id").select("report_id", F.lit("exact_id").alias("tier"), "execs", F.col("report_id").alias("object_id"))
    done = materialize(by_id, "tier0")
    for tier, keys in (("full_path", ["norm", "path"]), ("exact_name", ["norm"])):
        rest = inv.join(done.select("report_id"), "report_id", "left_anti")
        free = act.join(done.select("object_id"), "object_id", "left_anti")
        if tier == "exact_name":
            rest, free = rest.where("norm <> ''"), free.where("norm <> ''")
        mine = rest.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("report_id")))
        theirs = free.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("execs"), "object_id")))
        found = mine.join(theirs.select(*keys, "turn", "object_id", "execs"), [*keys, "turn"]).select("report_id", F.lit(tier).alias("tier"), "execs", "object_id")
        done = materialize(done.unionByName(found), tier)
    none = inv.join(done.select("report_id"), "report_id", "left_anti").select("report_id", F.lit("none").alias("tier"), F.lit(0).cast("long").alias("execs"))
    return done.select("report_id", "tier", F.col("execs").cast("long").alias("execs")).unionByName(none)


#: Least characters of two names of which one may contain the other, and the score that this gives at least.
CONTAINED_CHARS, CONTAINED_SCORE = 8, 0.7
SAME_PATH = 0.15


def fuzzy(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """Best match for rows (id, name, path): ``id``, ``match``, ``score``; the least match of several.

    The score is the Jaccard similarity of the names' tokens, CONTAINED_SCORE at
    least if one name of CONTAINED_CHARS or more contains the other, and
    SAME_PATH more on one path.  Names of one token match nothing.  Names and
    paths are made distinct before pairs are formed.  A pair shares a token of
    both prefixes, or the first characters of one name stand in the other, or it
    has one path; other pairs cannot reach the score.
    """
    from tessera.functions.sets import jaccard
    from tessera.operators.similarity import prefix

    def names(df):
        n = norm_starred_name(F.coalesce("name", F.lit("")))
        return df.select("id", n.alias("n"), norm_path(F.coalesce("path", F.lit(""))).alias("path")).withColumn("s", F.array_sort(name_tokens(F.col("n"))))

    def grams(n):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(n) - (CONTAINED_CHARS - 1)), lambda i: F.substr(n, i, F.lit(CONTAINED_CHARS))))

    a = materialize(names(left).where(F.size("s") >= 2), "names")
    b = materialize(names(right), "records")
    na = a.select("n", "s").distinct()
    nb = b.groupBy("n", "s").agg(F.min("id").alias("match"))

    def of(rows, keys):
        return rows.select("*", F.explode(keys).alias("k"))

    def met(x, y):
        return x.alias("a").join(y.alias("b"), F.col("a.k") == F.col("b.k")).select(F.col("a.n").alias("n"), F.col("a.s").alias("s"), F.col("b.n").alias("m"), F.col("b.s").alias("t"), F.col("b.match").alias("match"))

    start, long = F.array(F.substring("n", 1, CONTAINED_CHARS)), F.length("n") >= CONTAINED_CHARS
    some = F.size("s") > 0
    pairs = met(of(na, prefix(F.col("s"), least)), of(nb.where(some), prefix(F.col("s"), least)))
    pairs = pairs.unionByName(met(of(na.where(long), start), of(nb.where(long), grams(F.col("n")))))
    pairs = pairs.unionByName(met(of(na.where(long), grams(F.col("n"))), of(nb.where(long), start)))
    score = jaccard(F.col("s"), F.col("t"), 0.0)
    inside = (F.length("n") >= CONTAINED_CHARS) & (F.length("m") >= CONTAINED_CHARS) & (F.contains("n", "m") | F.contains("m", "n"))
    score = F.when(inside, F.greatest(score, F.lit(CONTAINED_SCORE))).otherwise(score)
    best = F.max_by(F.struct("match", "score"), F.struct("score", -F.col("match")))
    by_name = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("n").agg(best.alias("m")).select("n", "m.match", "m.score")

    pa = a.where("path <> ''").select("n", "s", "path").distinct().alias("a")
    pb = b.where("path <> ''").groupBy("path", "n", "s").agg(F.min("id").alias("match")).alias("b")
    score = jaccard(F.col("a.s"), F.col("b.s"), 0.0) + SAME_PATH
    on = (F.col("a.path") == F.col("b.path")) & (score >= least)
    by_path = pa.join(pb, on).select(F.col("a.n").alias("n"), F.col("a.path").alias("path"), "match", score.alias("score"))
    by_path = by_path.groupBy("n", "path").agg(best.alias("m")).select("n", "path", F.col("m.match").alias("match2"), F.col("m.score").alias("score2"))
    out = a.select("id", "n", "path").join(by_name, "n", "left").join(by_path, ["n", "path"], "left")
    first = F.coalesce(F.col("score"), F.lit(0.0)) >= F.coalesce(F.col("score2"), F.lit(0.0))
    out = out.select("id", F.when(first, F.col("match")).otherwise(F.col("match2")).alias("match"), F.greatest("score", "score2").alias("score"))
    return out.where(F.col("score").isNotNull())


def by_name(inventory: DataFrame, activity: DataFrame, reference: str, months: int = 18) -> DataFrame:
    """``report_id``, ``matched``, ``execs``, ``last``, ``retire`` by the exact name only.

    A report is retired if it has no match, or was last used more than 30 days
    times ``months`` before the reference date, or never.
    """
    name = norm_starred_name(F.coalesce("name", F.lit("")))
    per = activity.groupBy(name.alias("norm")).agg(F.sum("execs").alias("execs"), F.max("last").alias("last")).where("norm <> ''")
    rows = inventory.withColumn("norm", name).join(per, "norm", "left")
    cutoff = F.expr(f"TIMESTAMP '{reference}' - INTERVAL {30 * months} DAY")
    return rows.select("report_id", F.col("execs").isNotNull().alias("matched"), F.coalesce("execs", F.lit(0)).alias("execs"), "last", (F.col("last").isNull() | (F.col("last") < cutoff)).alias("retire"))
