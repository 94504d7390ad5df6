"""Trees of any depth from parent and child rows, a level at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize


def trees(relations: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``node``, ``parent`` (null for a root), ``depth`` (0 for a root), ``path`` (nodes from the root on) of each way down from a root.

    Relations (parent, child) are restricted to ``members`` (node), if given.
    Roots are parents that are nobody's child.  A node with two parents is met on
    both ways; a way ends before it meets a node again, so cycles end, and what
    lies on cycles only is on no way.  Each level is written and joined to the
    relations, so neither depth nor the number of ways has a limit.
    """
    rows = relations.where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").select("parent", "child").distinct()
    if members is not None:
        for end in ("parent", "child"):
            rows = rows.join(members.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    rows = materialize(rows, "relations")
    roots = rows.select(F.col("parent").alias("node")).distinct().join(rows.select(F.col("child").alias("node")), "node", "left_anti")
    kind = rows.schema["parent"].dataType
    levels = [materialize(roots.select("node", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), F.array("node").alias("path")), "level")]
    while levels[-1].limit(1).count():
        below = levels[-1].select(F.col("node").alias("parent"), F.col("depth") + 1, "path").toDF("parent", "depth", "path").join(rows, "parent").where(~F.array_contains("path", F.col("child")))
        levels.append(materialize(below.select(F.col("child").alias("node"), "parent", "depth", F.array_append("path", F.col("child")).alias("path")), "level"))
    return reduce(DataFrame.unionByName, levels)


def leaves(ways: DataFrame) -> DataFrame:
    """The ways that no other one goes on from."""
    inner = ways.where("parent IS NOT NULL").select(F.slice("path", F.lit(1), F.col("depth")).alias("path"))
    return ways.join(inner, "path", "left_anti")
