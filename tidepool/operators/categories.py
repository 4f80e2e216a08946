"""Category tree: nodes, reachability and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import stage_table


def category_edges(tree: DataFrame) -> DataFrame:
    """Distinct ``<child, parent>`` edges; roots (null parent) have none."""
    return tree.where("child is not null and parent is not null").select("child", "parent").distinct()


def category_nodes(tree: DataFrame) -> DataFrame:
    ids = tree.select(F.explode(F.array("child", "parent")).alias("category"))
    return ids.where(F.col("category").isNotNull()).distinct()


def category_ancestors(tree: DataFrame) -> DataFrame:
    """``<category, ancestor, distance>`` for every node reachable by following parents.

    Path doubling: a round joins all known paths end to end and keeps the shortest per pair, so a tree of
    depth d takes log2(d) rounds. A cycle adds nothing, as a node reaches itself only with distance 0, which is
    not stored. Every round is a written table; the loop ends when neither a pair nor a distance is new.
    """
    one_step = category_edges(tree).where("child <> parent")
    paths = stage_table(one_step.select(F.col("child").alias("category"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "closure")
    known = None
    while True:
        state = paths.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if state == known:
            return paths
        known = state
        on = paths.select(F.col("category").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        longer = paths.join(on, "ancestor").where("category <> above").select("category", F.col("above").alias("ancestor"), F.expr("distance + more"))
        shortest = paths.union(longer).groupBy("category", "ancestor").agg(F.min("distance").alias("distance"))
        paths = stage_table(shortest, "closure")


def category_similarity(tree: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Non-zero cells ``<cat_a, cat_b, sim>``: 1 on the diagonal, 1 / (1 + distance) along a lineage.

    The path from a to b goes before the one from b to a, which matters only inside a cycle.
    """
    closure = category_ancestors(tree) if closure is None else closure
    up = closure.select(F.col("category").alias("cat_a"), F.col("ancestor").alias("cat_b"), "distance", F.lit(0).alias("way"))
    down = up.select(F.col("cat_b").alias("cat_a"), F.col("cat_a").alias("cat_b"), "distance", F.lit(1).alias("way"))
    chosen = up.unionByName(down).groupBy("cat_a", "cat_b").agg(F.min(F.struct("way", "distance")).alias("best"))
    lineage = chosen.select("cat_a", "cat_b", (1 / (1 + F.col("best.distance"))).alias("sim"))
    same = category_nodes(tree).select(F.col("category").alias("cat_a"), F.col("category").alias("cat_b"), F.lit(1.0).alias("sim"))
    return lineage.unionByName(same)


def common_ancestor_similarity(pairs: DataFrame, tree: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``<cat_a, cat_b, sim>`` of the asked pairs: 1 / (1 + min(d1 + d2)) over shared ancestors, else 0.

    Every category counts as its own ancestor with distance 0. Work per pair is the depth of the
    tree; the pairs below a root are never enumerated.
    """
    closure = category_ancestors(tree) if closure is None else closure
    own = category_nodes(tree).select("category", F.col("category").alias("ancestor"), F.lit(0).alias("distance"))
    reach = stage_table(closure.unionByName(own), "category-reach")
    asked = stage_table(pairs.select("cat_a", "cat_b").distinct(), "category-pairs")
    left = reach.select(F.col("category").alias("cat_a"), "ancestor", F.col("distance").alias("d1"))
    right = reach.select(F.col("category").alias("cat_b"), "ancestor", F.col("distance").alias("d2"))
    shortest = (
        asked.join(left, "cat_a")
        .join(right, ["cat_b", "ancestor"])
        .groupBy("cat_a", "cat_b")
        .agg(F.min(F.col("d1") + F.col("d2")).alias("steps"))
    )
    sim = F.coalesce(1 / (1 + F.col("steps")), F.lit(0.0))
    return asked.join(shortest, ["cat_a", "cat_b"], "left").select("cat_a", "cat_b", sim.alias("sim"))
