"""Imported cluster reviews and similarity files, each in the two shapes that they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = ["label", "business_function", "relationship", "consolidation_action", "confidence", "consolidation_detail", "keep_report"]


def part(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def reviews_of(documents: DataFrame) -> DataFrame:
    """``project``, ``shape``, ``place``, ``cluster_id``, TEXTS, ``removable_count`` from JSON documents (project, value).

    A document is a list of reviews as they are, or an object whose ``reviews``
    have a number and keep their fields under ``analysis``; a list may hold
    reviews of the second kind as well.  Missing texts are empty, missing counts
    0; reviews without a cluster and documents that are no JSON are left out.
    """
    rows = documents.select("project", F.try_parse_json("value").alias("v"))
    inside, alone = part(F.col("v"), "$.reviews", "array<variant>"), part(F.col("v"), "$", "array<variant>")
    # the shape is told once for each document, before the rows are made: told beside them, the document is read again for each
    rows = rows.select("project", inside.alias("inside"), alone.alias("alone")).select("project", F.col("inside").isNotNull().alias("wrapped"), F.coalesce("inside", "alone").alias("all"))
    rows = rows.select("project", "wrapped", F.posexplode("all").alias("place", "r"))
    nested = F.col("wrapped") | part(F.col("r"), "$.analysis", "variant").isNotNull()
    number = part(F.col("r"), "$.clusterId")
    cluster = F.when(nested, F.concat(F.lit("C"), number)).otherwise(number)

    def value(name: str, kind: str = "string") -> Column:
        own = "action" if name == "consolidation_action" else name
        return F.when(nested, part(F.col("r"), f"$.analysis.{own}", kind)).otherwise(part(F.col("r"), f"$.{name}", kind))

    fields = [F.coalesce(value(c), F.lit("")).alias(c) for c in TEXTS]
    out = rows.select("project", F.when(nested, "nested").otherwise("canonical").alias("shape"), "place", cluster.alias("cluster_id"), *fields, F.coalesce(value("removable_count", "long"), F.lit(0)).alias("removable_count"))
    return out.where(F.coalesce("cluster_id", F.lit("")) != "")


def imported(documents: DataFrame) -> DataFrame:
    """One review for each cluster: of a project with canonical reviews these only, and of one cluster the last in its document."""
    rows = reviews_of(documents)
    shape = rows.groupBy("project").agg(F.min("shape").alias("shape"))  # "canonical" comes before "nested"
    rows = rows.join(shape, ["project", "shape"], "left_semi")
    fields = [*TEXTS, "removable_count"]
    last = rows.groupBy("project", "cluster_id").agg(F.max_by(F.struct(*fields), F.struct("place", *fields)).alias("r"))
    return last.select("project", "cluster_id", "r.*")


def action_counts(documents: DataFrame) -> DataFrame:
    """``project``, ``action``, ``n`` over all reviews that count, repeated ones too; an empty action is UNKNOWN."""
    rows = reviews_of(documents)
    shape = rows.groupBy("project").agg(F.min("shape").alias("shape"))
    rows = rows.join(shape, ["project", "shape"], "left_semi")
    action = F.coalesce(F.nullif("consolidation_action", F.lit("")), F.lit("UNKNOWN"))
    return rows.groupBy("project", action.alias("action")).agg(F.count("*").alias("n"))


def emitted(reviews: DataFrame) -> DataFrame:
    """Reviews in the shape that they are handed out in, which ``reviews_of`` reads again as the canonical one."""
    return reviews.select("project", F.col("cluster_id").alias("clusterId"), *TEXTS, "removable_count")


def summary(reviews: DataFrame) -> DataFrame:
    """One row: ``reviewed``, ``removable``, ``safe`` (confidence high, something removable), and counts by action as a map."""
    action = F.coalesce(F.nullif(F.upper(F.trim("consolidation_action")), F.lit("")), F.lit("UNKNOWN"))
    by = reviews.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.sum("removable_count").alias("removable"), F.count_if((F.lower("confidence") == "high") & (F.col("removable_count") > 0)).alias("safe"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reviewed"), F.coalesce(F.sum("removable"), F.lit(0)).alias("removable"), F.coalesce(F.sum("safe"), F.lit(0)).alias("safe"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("by_action"))


def opportunities(reviews: DataFrame, most: int = 12) -> DataFrame:
    """The reviews that free most reports, errors excluded; ties by cluster."""
    action = F.upper(F.coalesce("consolidation_action", F.lit("")))
    return reviews.where((action != "ERROR") & (F.col("removable_count") > 0)).orderBy(F.desc("removable_count"), "cluster_id").limit(most)


PAIR = ["combined", "metric", "table", "filter", "ast"]


def similarity_pairs(items: DataFrame, known: DataFrame) -> DataFrame:
    """``a``, ``b``, PAIR from the items of similarity files: entries ``"a|b": {...}`` of an object, or objects (a, b, score) of a list.

    Items (value) are those of ``json_items.items``, so a file of any size is
    split.  Pairs with an end that ``known`` (report_id) lacks are left out; of
    one pair the greatest score stays.
    """
    entry = F.substring("value", 1, 1) == '"'
    v = F.try_parse_json(F.when(entry, F.concat(F.lit("{"), "value", F.lit("}"))).otherwise(F.col("value")))
    rows = items.select(entry.alias("entry"), v.alias("v"))
    keyed = rows.where("entry").select(F.explode(part(F.col("v"), "$", "map<string,variant>")).alias("k", "s"))
    ends = F.split("k", r"\|", 2)
    keyed = keyed.where(F.contains("k", F.lit("|"))).select(ends[0].alias("a"), ends[1].alias("b"), *[part(F.col("s"), f"$.{c}", "double").alias(c) for c in PAIR])
    listed = rows.where(~F.col("entry")).select(part(F.col("v"), "$.a").alias("a"), part(F.col("v"), "$.b").alias("b"), part(F.col("v"), "$.score", "double").alias("combined"), *[F.lit(None).cast("double").alias(c) for c in PAIR[1:]])
    rows = keyed.unionByName(listed)
    for end in "ab":
        rows = rows.join(known.select(F.col("report_id").cast("string").alias(end)).distinct(), end, "left_semi")
    return rows.groupBy("a", "b").agg(F.max(F.struct(*PAIR)).alias("s")).select("a", "b", "s.*")
