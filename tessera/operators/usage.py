"""Usage, status and coverage operators of a catalogue of reports, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import location


def prefixed(path: Column, project: str) -> Column:
    """Whether a path lies in a project, with or without a leading slash."""
    return path.startswith(f"/{project}/") | path.startswith(f"{project}/")


def contains_any(x: Column, marks: list[str]) -> Column:
    """Whether a text contains one of the marks, without regard to case; null does not."""
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(False)
    for mark in marks:
        out |= F.contains(low, F.lit(mark.lower()))
    return out


def without_admin_profiles(activity: DataFrame, marks: list[str], admins: list[str]) -> DataFrame:
    """Rows (folder, user) that are not an administrator's use of a personal folder."""
    return activity.where(~(contains_any(F.col("folder"), marks) & F.lower(F.coalesce("user", F.lit(""))).isin([x.lower() for x in admins])))


def rollup(activity: DataFrame, *keys: str) -> DataFrame:
    """``execs``, ``users``, ``last``, ``sessions``, ``errors`` for each key; users are told apart within a key."""
    return activity.groupBy(*keys).agg(F.sum("execs").alias("execs"), F.count_distinct("user").alias("users"), F.max("last").alias("last"), F.sum("sessions").alias("sessions"), F.sum("errors").alias("errors"))


def merged_rollup(rolled: DataFrame, key: str) -> DataFrame:
    """A rollup's rows of one key together; users are the greatest of its folders' counts, not a distinct count."""
    return rolled.groupBy(key).agg(F.sum("execs").alias("execs"), F.max("users").alias("users"), F.max("last").alias("last"), F.sum("sessions").alias("sessions"), F.sum("errors").alias("errors"))


def latest(activity: DataFrame, key: str, time: str, *kept: str) -> DataFrame:
    """The columns ``kept`` of each key's latest row (the greatest ones of several), its executions and its named users."""
    row = F.max_by(F.struct(*kept), F.struct(time, *kept))
    return activity.groupBy(key).agg(row.alias("r"), F.sum("execs").alias("execs"), F.count_distinct(F.when(F.coalesce("user", F.lit("")) != "", F.col("user"))).alias("users")).select(key, "r.*", "execs", "users")


def heavy_users(activity: DataFrame, most: int = 100, services: list[str] | None = None) -> DataFrame:
    """The users with most executions, and whether a name is a service account's."""
    per = activity.groupBy("user").agg(F.sum("execs").alias("execs"), F.count_distinct("object_id").alias("objects"), F.sum("sessions").alias("sessions"), F.max("last").alias("last"))
    return per.withColumn("service", contains_any(F.col("user").cast("string"), services or [])).orderBy(F.desc("execs"), "user").limit(most)


def tier_histogram(telemetry: DataFrame) -> DataFrame:
    """Reports by kind of match: those that start with exact or fuzzy are folded, the path tier is not counted."""
    tier = F.when(F.col("tier").startswith("exact"), "exact").when(F.col("tier").startswith("fuzzy"), "fuzzy").when(F.col("tier") == "none", "none")
    return telemetry.groupBy(tier.alias("tier")).agg(F.count("*").alias("n")).where(F.col("tier").isNotNull())


def action_histogram(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.coalesce(F.nullif("action", F.lit("")), F.lit("UNKNOWN")).alias("action")).agg(F.count("*").alias("n"))


def retired(reports: DataFrame, telemetry: DataFrame, batches: list[str]) -> DataFrame:
    """Distinct ids of reports that lie in a retired batch or have a telemetry row without a match."""
    lost = telemetry.where(~F.col("matched")).select("report_id").distinct().withColumn("lost", F.lit(True))
    return reports.join(lost, "report_id", "left").where(F.col("batch").isin(batches) | F.col("lost").isNotNull()).select("report_id").distinct()


def quadrants(all_ids: DataFrame, jaccard_ids: DataFrame, semantic_ids: DataFrame) -> DataFrame:
    """``id`` with ``category``: in both clusterings, in one, or in neither."""
    j = jaccard_ids.select("id").distinct().withColumn("j", F.lit(True))
    s = semantic_ids.select("id").distinct().withColumn("s", F.lit(True))
    has_j, has_s = F.col("j").isNotNull(), F.col("s").isNotNull()
    category = F.when(has_j & has_s, "both").when(has_j, "jaccardOnly").when(has_s, "semanticOnly").otherwise("neither")
    return all_ids.join(j, "id", "left").join(s, "id", "left").select("id", category.alias("category"))


def in_category_order(rows: DataFrame) -> DataFrame:
    place = F.when(F.col("category") == "both", 0).when(F.col("category") == "semanticOnly", 1).when(F.col("category") == "jaccardOnly", 2).otherwise(3)
    return rows.orderBy(place, F.desc("execs"), "id")


def location_pivot(reports: DataFrame) -> DataFrame:
    """Reports (path, disposition) by place: active, retired and all."""
    return reports.groupBy(location(F.col("path")).alias("place")).agg(F.count_if(F.col("disposition") == "retain").alias("active"), F.count_if(F.col("disposition") == "retire").alias("retire"), F.count("*").alias("total"))


def disposition(reports: DataFrame, retained: DataFrame, retire: DataFrame) -> DataFrame:
    """Rows (report_id, kept) with the final word: a user's retention first, a user's retirement next, then the funnel's."""
    a = retained.select("report_id").distinct().withColumn("_a", F.lit(True))
    b = retire.select("report_id").distinct().withColumn("_b", F.lit(True))
    word = F.when(F.col("_a").isNotNull(), "retain").when(F.col("_b").isNotNull(), "retire").when(F.col("kept"), "retain").otherwise("retire")
    source = F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), "user").otherwise("funnel")
    return reports.join(a, "report_id", "left").join(b, "report_id", "left").withColumn("disposition", word).withColumn("decided_by", source).drop("_a", "_b")


def effective_final(final: DataFrame, retained: DataFrame, retire: DataFrame, experiment: DataFrame | None = None) -> DataFrame:
    """Ids kept: the experiment's if there is one, else the funnel's; with the users' retentions, without their retirements."""
    base = (final if experiment is None else experiment).select("report_id")
    return base.unionByName(retained.select("report_id")).distinct().join(retire.select("report_id"), "report_id", "left_anti")


def toggle(state: DataFrame, other: DataFrame, ids: DataFrame, on: bool) -> tuple[DataFrame, DataFrame]:
    """The lists after ids are put on one (and so taken from the other), or taken off it."""
    ids = ids.select("report_id").distinct()
    if not on:
        return state.join(ids, "report_id", "left_anti"), other
    return state.select("report_id").unionByName(ids).distinct(), other.join(ids, "report_id", "left_anti")


def feature_counts(reports: DataFrame, features: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct features (report_id, kind, name) of each kind for each report; 0 without any."""
    per = features.groupBy("report_id").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("name"))).alias(f"n_{k}") for k in kinds])
    return reports.join(per, "report_id", "left").select(*reports.columns, *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds])


def backfilled(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` filled from the source where it is blank there and not in the source; the least of several values."""
    known = source.where(F.coalesce(column, F.lit("")) != "").groupBy(key).agg(F.min(column).alias("_known"))
    blank = F.coalesce(F.col(column), F.lit("")) == ""
    return rows.join(known, key, "left").withColumn(column, F.when(blank, F.coalesce("_known", column)).otherwise(F.col(column))).drop("_known")


def enriched(rows: DataFrame, key: str, column: str, sources: list[DataFrame], missing: str) -> DataFrame:
    """The first source that knows a key's value gives it."""
    found = []
    for i, source in enumerate(sources):
        rows = rows.join(source.groupBy(key).agg(F.min(column).alias(f"_{i}")), key, "left")
        found.append(F.col(f"_{i}"))
    return rows.withColumn(column, F.coalesce(*found, F.lit(missing))).drop(*[f"_{i}" for i in range(len(sources))])


def family_status(members: DataFrame) -> DataFrame:
    """Members (family, execs) as families: all active, all retired or partial, with counts."""
    active = F.count_if(F.col("execs") > 0)
    per = members.groupBy("family").agg(F.count("*").alias("size"), active.alias("active"))
    return per.withColumn("status", F.when(F.expr("active = size"), "all active").when(F.expr("active = 0"), "all retired").otherwise("partial"))


def unused(all_names: DataFrame, used_names: DataFrame) -> DataFrame:
    """Distinct names that no report uses, without regard to case."""
    return all_names.select(F.lower("name").alias("name")).distinct().join(used_names.select(F.lower("name").alias("name")).distinct(), "name", "left_anti")


def frequency(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """The most frequent values, or all of them, the least of those with one count first."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if most is None else counts.limit(most)


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts and their part in percent of all rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(total).select(column, "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))  # one row on the right


def cost(texts: DataFrame, text: Column, price_per_1k: float) -> DataFrame:
    """A token for each four characters, one at least, and the price."""
    tokens = F.greatest(F.lit(1).cast("long"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long"))
    return texts.withColumn("tokens", tokens).withColumn("price", F.col("tokens") / 1000 * price_per_1k)


def row_counts(tables: dict[str, DataFrame], by: str | None = None) -> DataFrame:
    """``name``, ``n`` (and ``by``) of each table."""
    from functools import reduce

    keys = [by] if by else []
    return reduce(DataFrame.unionByName, [t.groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), *keys, "n") for name, t in tables.items()])


def stage_steps(counts: DataFrame) -> DataFrame:
    """Stages (ordinal, stage, remaining) with what each removed, its percent of the first, and of the one before."""
    from pyspark.sql.window import Window

    w = Window.partitionBy().orderBy("ordinal")  # a row for each stage
    before = F.lag("remaining").over(w)
    return counts.select("ordinal", "stage", "remaining", F.coalesce(before - F.col("remaining"), F.lit(0)).alias("removed"), (F.lit(100.0) * F.col("remaining") / F.first("remaining").over(w)).alias("percent"), (F.lit(100.0) * F.col("remaining") / F.coalesce(before, "remaining")).alias("percent_of_previous"))
