"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` for each node on an edge; component is the least node reached.

    Each round takes the least label among a node and its neighbours, hooks the
    label's own row to it, and then follows labels once (pointer jumping), so
    the rounds grow with the logarithm of the longest path.  Labels live in a
    table written each round; only a count of changes reaches the driver.
    Loops, repeated edges and both directions are allowed; null ends are ignored.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v"))
    pairs = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        seen = pairs.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        hooks = labels.join(seen, labels["node"] == seen["u"]).select("node", "label", "low")
        offers = hooks.select("node", "low").unionByName(hooks.select(F.col("label").alias("node"), "low"))
        offers = offers.groupBy("node").agg(F.min("low").alias("low"))
        lower = labels.join(offers, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        lower, before = materialize(lower, "hooked"), labels
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = lower.join(jump, "label").select("node", F.col("beyond").alias("label"), (F.col("was") != F.col("beyond")).alias("moved"))
        labels = materialize(jumped, "labels")
        discard(lower, before)
        if not labels.where("moved").limit(1).count():
            discard(pairs)
            found = labels.select("node", F.col("label").alias("component"))
            found._stored_at = labels._stored_at
            return found


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """As ``connected_components``, for many edges: those of each node's least neighbour first, then what they leave apart."""
    pairs = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")), "stars")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = connected_components(both.groupBy("v").agg(F.min("u").alias("u")), "u", "v")
    u = near.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    v = near.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    apart = materialize(pairs.join(v, "v").join(u, "u").where("cu <> cv").select("cu", "cv").distinct(), "apart")
    far = connected_components(apart, "cu", "cv").withColumnRenamed("node", "near").withColumnRenamed("component", "far")
    found = materialize(near.join(far, F.col("component") == F.col("near"), "left").select("node", F.coalesce("far", "component").alias("component")), "components")
    discard(pairs, apart, near)
    return found
