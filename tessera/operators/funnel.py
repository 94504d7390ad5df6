"""The whole funnel: from an inventory and its usage, stage by stage, to the reports that stay.

Each stage is one table ``(report_id, canonical_id)`` of groups found among the
survivors of the stage before; nothing but counts of stages reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import family_base, sql_for_hash
from tessera.operators import dedup, similarity
from tessera.operators.graph import connected_components, star_components
from tessera.operators.ranking import canonical
from tessera.storage import materialize

# The stages that collapse reports, in order.
STAGES = ["collision", "fingerprint", "sql_hash", "ast", "family", "similarity"]
#: The order of batches, in which the first row of a report wins.
BATCHES = {"original": 0, "inventory": 0, "new": 1, "added": 2, "dossier": 3}


def active_universe(inventory: DataFrame, telemetry: DataFrame, batches: dict[str, int], *order: str) -> DataFrame:
    """One row for each used report of the batches: the first by batch, then by ``order``; with its telemetry."""
    rank = F.create_map(*[F.lit(x) for kv in batches.items() for x in kv])[F.col("batch")]
    rows = inventory.where(F.col("batch").isin(list(batches)))
    one = rows.groupBy("report_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "report_id"]), F.struct(rank.alias("rank"), *order)).alias("r")).select("report_id", "r.*")
    return one.join(telemetry.where("execs > 0"), "report_id")


def scope(result: Result, name: str) -> DataFrame:
    """``report_id`` of a named scope of a run; of a stage that the run left out, what the stages before it kept."""
    if name == "final-kept":
        return result.final.select("report_id")
    place = {"active": "universe", "post-collision": "collision", "post-ast": "ast", "post-family": "family"}[name]
    order = ["universe", *STAGES]
    ran = [n for n in order[: order.index(place) + 1] if n in result.kept]
    return result.kept[ran[-1]].select("report_id")


def of_source(reports: DataFrame, ids: DataFrame, source: str) -> DataFrame:
    """Ids restricted to a source type; ``exclude-cube`` takes the cubes out, ``all`` none."""
    if source == "all":
        return ids
    if source == "exclude-cube":
        return ids.join(reports.where("source_type = 'cube'").select("report_id"), "report_id", "left_anti")
    return ids.join(reports.where(F.col("source_type") == source).select("report_id"), "report_id", "left_semi")


def final_kept(rows: DataFrame, members: DataFrame, primaries: DataFrame, key: str = "report_id") -> DataFrame:
    """Rows outside all clusters, and the clusters' primaries."""
    return rows.select(key).join(members.select(key), key, "left_anti").unionByName(primaries.select(key)).distinct()


def grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``report_id``, ``canonical_id`` from components (node, component) of rows (report_id, execs): the most executed member."""
    named = rows.join(found, F.col("report_id") == F.col("node")).select("report_id", "execs", "component")
    best = named.groupBy("component").agg(canonical("report_id", "execs").alias("canonical_id"))
    return named.join(best, "component").select("report_id", "canonical_id")


def by_statement(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Groups of equal normalised statements."""
    known = rows.join(statements.where(F.coalesce("sql", F.lit("")) != "").select("report_id", "sql"), "report_id")
    return dedup.groups_by(known, [F.sha2(sql_for_hash(F.col("sql")), 256)])


def by_syntax(rows: DataFrame, hashes: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Groups of reports whose sets of subtree hashes are alike, and links that connect them; equal sets are one set when links are looked for."""
    known = rows.join(hashes.where(F.size("hashes") > 0), "report_id").select("report_id", "execs", F.array_sort(F.array_distinct("hashes")).alias("s"))
    known = materialize(known, "syntax-known")
    sets = materialize(known.groupBy("s").agg(F.min("report_id").alias("id"), F.count("*").alias("n")), "syntax-sets")
    links = materialize(similarity.link_edges(materialize(similarity.set_links(sets, "id", "s", least), "syntax-set-links")), "syntax-links")
    found = star_components(links, "a", "b")
    copies = known.join(sets, "s").select("report_id", "execs", "id", "n").join(found, F.col("id") == F.col("node"), "left")
    copies = copies.where((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "id"))
    best = copies.groupBy("component").agg(canonical("report_id", "execs").alias("canonical_id"))
    return copies.join(best, "component").select("report_id", "canonical_id", "component"), links


def by_family(rows: DataFrame) -> DataFrame:
    """Groups of one name without its last part; reports without a name are in no family."""
    named = rows.where(F.coalesce(F.trim("name"), F.lit("")) != "")
    return dedup.groups_by(named, [F.lower(family_base(F.col("name")))])


def by_similarity(rows: DataFrame, sets: DataFrame, least: float = 0.8, hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters of the weighted similarity of feature sets, and the links between distinct triples of sets."""
    known = rows.join(sets, "report_id")
    keys = ["m", "t", "f"]
    if hashes is not None:
        known = known.join(hashes.select("report_id", F.array_sort(F.array_distinct("hashes")).alias("x")), "report_id", "left")
        known = known.withColumn("x", F.coalesce("x", F.array().cast("array<string>")))
        keys = [*keys, "x"]
    triples = materialize(known.groupBy(*keys).agg(F.min("report_id").alias("id"), F.count("*").alias("n")), "triples")
    links = materialize(similarity.weighted_set_join(triples, least), "similar")
    found = connected_components(links, "a", "b")
    copies = known.join(triples, keys).select("report_id", "execs", "id", "n").join(found, F.col("id") == F.col("node"), "left")
    copies = copies.where((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "id"))
    best = copies.groupBy("component").agg(canonical("report_id", "execs").alias("canonical_id"))
    return copies.join(best, "component").select("report_id", "canonical_id", "component"), links


@dataclass
class Result:
    """``members`` and ``kept`` by stage (``universe`` is kept before any), the ids kept in the end, and links by kind."""

    inventory: DataFrame
    members: dict[str, DataFrame] = field(default_factory=dict)
    kept: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[str, DataFrame] = field(default_factory=dict)
    final: DataFrame | None = None

    def counts(self) -> DataFrame:
        """``ordinal``, ``stage``, ``remaining`` of the inventory and each stage."""
        tables = [("inventory", self.inventory.select("report_id").distinct()), *self.kept.items(), ("final", self.final)]
        rows = [t.agg(F.count("*").alias("remaining")).select(F.lit(i).alias("ordinal"), F.lit(n).alias("stage"), "remaining") for i, (n, t) in enumerate(tables, 1)]
        return reduce(DataFrame.unionByName, rows)

    def survivors(self) -> DataFrame:
        """``report_id``, ``survivor_id``, ``stage``: where each report of the inventory leads, through all stages, and the first stage that collapsed it.

        Unused reports lead nowhere.  There are as many joins as stages, so no
        chain is followed row by row.
        """
        rows = self.inventory.select("report_id").distinct().join(self.kept["universe"].select("report_id", F.col("report_id").alias("survivor_id")), "report_id", "left")
        rows = rows.withColumn("stage", F.when(F.col("survivor_id").isNull(), "telemetry"))
        for name, members in self.members.items():
            step = members.where("report_id <> canonical_id").select(F.col("report_id").alias("survivor_id"), "canonical_id")
            rows = rows.join(step, "survivor_id", "left")
            rows = rows.select("report_id", F.coalesce("canonical_id", "survivor_id").alias("survivor_id"), F.coalesce("stage", F.when(F.col("canonical_id").isNotNull(), name)).alias("stage"))
        return rows

    def outcomes(self) -> DataFrame:
        """``report_id``, ``stage``, ``outcome``: kept, collapsed or primary in each stage that it reached; retired where it was never used."""
        parts = [self.inventory.select("report_id").distinct().join(self.kept["universe"].select("report_id"), "report_id", "left_anti").select("report_id", F.lit("telemetry").alias("stage"), F.lit("retired").alias("outcome"))]
        before = self.kept["universe"]
        for name, members in self.members.items():
            rows = before.select("report_id").join(members.select("report_id", "canonical_id"), "report_id", "left")
            outcome = F.when(F.col("canonical_id").isNull(), "kept").when(F.col("canonical_id") == F.col("report_id"), "primary").otherwise("collapsed")
            parts.append(rows.select("report_id", F.lit(name).alias("stage"), outcome.alias("outcome")))
            before = self.kept.get(name, before)
        return reduce(DataFrame.unionByName, parts)


def run_pipeline(inventory: DataFrame, features: DataFrame, telemetry: DataFrame, statements: DataFrame | None = None, hashes: DataFrame | None = None, batches: dict[str, int] | None = None, mode: str = "reference", last: str | None = None) -> Result:
    """All stages in order, or those up to ``last`` (``universe`` or ``family``) only, without a final scope.

    Inventory (report_id, batch, name), features (report_id, m, t, f), telemetry
    (report_id, execs, last, tier), statements (report_id, sql), hashes
    (report_id, hashes).  In mode ``reference`` groups of equal statements span
    all reports after collisions, so one's elected member may be gone already and
    its last survivor collapse; in mode ``sequential`` they are sought among
    survivors.
    """
    out = Result(inventory)
    rows = materialize(active_universe(inventory, telemetry, batches or BATCHES, "name"), "universe")
    out.kept["universe"] = rows
    if last == "universe":
        return out

    def stage(name: str, members: DataFrame) -> None:
        members = materialize(members.select("report_id", "canonical_id"), name)
        out.members[name] = members
        before = list(out.kept.values())[-1]
        out.kept[name] = materialize(dedup.survivors(before, members), f"after-{name}")

    found = dedup.collisions(rows.select("report_id", "name", "execs", "last", "tier"))
    stage("collision", found)
    after_collisions = out.kept["collision"]
    # what later stages read is aggregated for the reports that reach them only
    reached = after_collisions.select("report_id")
    sets = materialize(dedup.feature_sets(features.join(reached, "report_id", "left_semi")), "sets")
    if hashes is not None:
        hashes = materialize(hashes.join(reached, "report_id", "left_semi"), "hashes")
    stage("fingerprint", dedup.fingerprint(after_collisions.join(sets, "report_id")))
    if statements is not None:
        stage("sql_hash", by_statement(after_collisions if mode == "reference" else out.kept["fingerprint"], statements))
    if hashes is not None:
        found, out.links["ast"] = by_syntax(list(out.kept.values())[-1], hashes)
        stage("ast", found)
    stage("family", by_family(list(out.kept.values())[-1]))
    if last == "family":
        return out
    found, out.links["similarity"] = by_similarity(out.kept["family"], sets, hashes=hashes)
    stage("similarity", found)
    out.final = final_kept(out.kept["family"], out.members["similarity"], out.members["similarity"].select(F.col("canonical_id").alias("report_id")))
    return out


def why(result: Result, retained: DataFrame, retire: DataFrame) -> DataFrame:
    """``report_id``, ``why``: the first that holds of a user's word, then the stages from the last to the first."""
    a = retained.select("report_id").distinct().withColumn("_a", F.lit(True))
    b = retire.select("report_id").distinct().withColumn("_b", F.lit(True))
    rows = result.survivors().join(a, "report_id", "left").join(b, "report_id", "left")
    word = F.when(F.col("_a").isNotNull(), "retained by a user").when(F.col("_b").isNotNull(), "retired by a user").when(F.col("stage") == "telemetry", "not used").when(F.col("stage").isNotNull(), F.concat(F.lit("collapsed by "), "stage")).otherwise("kept")
    return rows.select("report_id", word.alias("why"))
