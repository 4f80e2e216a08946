"""Weighted user-item cells, dense ids and user selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.config import EVENT_WEIGHTS
from tidepool.functions.scalars import event_weight
from tidepool.session import stage_table

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def event_confidence(events: DataFrame, weights: dict[str, float] = EVENT_WEIGHTS) -> DataFrame:
    """Events with a ``confidence`` column; null for event types without a weight."""
    return events.withColumn("confidence", event_weight(F.col("event"), weights))


def interaction_matrix(events: DataFrame, weights: dict[str, float] = EVENT_WEIGHTS) -> DataFrame:
    """``<user_id, item_id, weight, n_events>``; event types without a weight make no cell."""
    return (
        event_confidence(events, weights)
        .where(F.col("confidence").isNotNull())
        .groupBy("user_id", "item_id")
        .agg(F.sum("confidence").alias("weight"), F.count(F.lit(1)).alias("n_events"))
    )


def event_pairs(events: DataFrame, weights: dict[str, float] = EVENT_WEIGHTS) -> DataFrame:
    """``<user_id, item_id, weight, n_events>`` of all pairs, written once; a pair of unweighted events alone has no weight and 0 events.

    ``weighted_pairs`` of it is ``interaction_matrix``, and its users and items are those of the events, so that the events are read once.
    """
    found = event_confidence(events, weights).groupBy("user_id", "item_id").agg(F.sum("confidence").alias("weight"), F.count("confidence").alias("n_events"))
    return stage_table(found, "event-pairs")


def weighted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("n_events > 0")


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """``<column, idx>`` with idx = 0, 1, 2, ... in id order, over the distinct ids of ``df``.

    A range sort puts the ids into ordered partitions, each row gets its place within its partition,
    and the partition sizes (one row per partition, hence safe to broadcast) give the offsets. The
    sorted table is written once so that both steps see the same partitions.
    """
    ordered = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    placed = stage_table(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered-ids")
    placed = placed.select(
        column,
        F.shiftright("place", _ROW_BITS).alias("part"),
        F.col("place").bitwiseAND((1 << _ROW_BITS) - 1).alias("row"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    return placed.join(F.broadcast(offsets), "part").select(column, (F.col("start") + F.col("row")).alias("idx"))


def user_index(events: DataFrame) -> DataFrame:
    return dense_index(events, "user_id").withColumnRenamed("idx", "user_idx")


def item_index(events: DataFrame) -> DataFrame:
    return dense_index(events, "item_id").withColumnRenamed("idx", "item_idx")


def index_interactions(cells: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Add both dense ids; rows with an unknown user or item are dropped."""
    return cells.join(users, "user_id").join(items, "item_id")


def known_only(requests: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Requests whose id is known; unknown ids simply get no answer."""
    return requests.select(key).distinct().join(index.select(key), key, "left_semi")


def matrix_summary(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: ``n_users, n_items, n_cells, total_weight, density``."""
    shape = events.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
    cells = matrix.agg(F.struct(F.count(F.lit(1)).alias("n_cells"), F.sum("weight").alias("total_weight"))).scalar()
    both = shape.withColumn("cells", cells).select("n_users", "n_items", "cells.n_cells", "cells.total_weight")
    return both.withColumn("density", F.try_divide(F.col("n_cells"), F.col("n_users") * F.col("n_items")))


def eligible_users(events: DataFrame, least: int = 2) -> DataFrame:
    """``<user_id, n_events>`` of users with at least ``least`` events."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= least)


def sample_users(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` users in hash order: the same users whatever the partitioning or row order."""
    draw = F.md5(F.concat(F.col("user_id").cast("string"), F.lit(f":{seed}")))
    return users.select("user_id").orderBy(draw, "user_id").limit(n)


def popular_items(matrix: DataFrame, m: int) -> DataFrame:
    """``<item_id, weight>``: the ``m`` items with the most weight."""
    totals = matrix.groupBy("item_id").agg(F.sum("weight").alias("weight"))
    return totals.orderBy(F.col("weight").desc(), F.col("item_id").asc()).limit(m)


def unseen_candidates(matrix: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Each user of ``matrix`` with the items of a short list (``limit``-bounded) they have no cell for."""
    items = shortlist.agg(F.collect_list("item_id")).scalar()
    offered = matrix.select("user_id").distinct().select("user_id", F.explode(items).alias("item_id"))
    return offered.join(matrix, ["user_id", "item_id"], "left_anti")
