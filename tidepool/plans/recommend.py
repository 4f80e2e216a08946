"""Batch recommendations: one list per requested user or item.

Every list is ``<key, item_id, score, rank>`` rows. Each leg is cut to its own top n before blending,
scores enter the blend unnormalised, and only the collaborative leg leaves out items already seen.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import ITEM_LEG_WEIGHTS, NEIGHBORS_PER_RECENT, USER_LEG_WEIGHTS
from tidepool.operators.neighbors import best_matches, knn_exact
from tidepool.operators.ranking import score_order, top_n
from tidepool.operators.sequences import likeliest_next
from tidepool.session import stage_table

USER_METHODS = ("hybrid", "cf", "content", "sequential")
ITEM_METHODS = ("hybrid", "cf", "content")


def check_method(method: str, allowed: tuple[str, ...]) -> None:
    if method not in allowed:
        raise ValueError(f"unknown method {method!r}; use one of {', '.join(allowed)}")


def cf_lists(user_factors: DataFrame, item_factors: DataFrame, seen: DataFrame, users: DataFrame, n: int, width: int) -> DataFrame:
    """Best unseen items by factor dot product, ``<user_id, item_id, score, rank>``.

    Seen pairs are masked inside the search, so a user with millions of seen items needs no larger
    candidate list than anybody else.
    """
    asked = user_factors.join(users.select("user_id"), "user_id", "left_semi")
    hidden = seen.join(users.select("user_id"), "user_id", "left_semi")
    found = best_matches(
        asked.select(F.col("user_id").alias("key"), "vec"),
        item_factors.select(F.col("item_id").alias("item"), "vec"),
        n, width, exclude=hidden.select(F.col("user_id").alias("key"), F.col("item_id").alias("item")),
    )
    return found.select(F.col("key").alias("user_id"), F.col("item").alias("item_id"), "score", "rank")


def without_seen(lists: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Rows whose pair is not in ``seen<user_id, item_id>``; all rows if it is None."""
    return lists if seen is None else lists.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def content_lists(recent: DataFrame, neighbors: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
    """Sum of neighbour scores over each user's recent items; a repeated item counts each time.

    ``recent<user_id, item_id>`` has a handful of rows per user and ``neighbors<item_id, neighbor_id,
    score>`` a handful per item. Pass both as tables so that a popular item is split in the join.
    """
    times = recent.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("times"))
    scored = (
        times.join(neighbors.select("item_id", "neighbor_id", "score"), "item_id")
        .groupBy("user_id", F.col("neighbor_id").alias("candidate"))
        .agg(F.sum(F.col("times") * F.col("score")).alias("score"))
        .withColumnRenamed("candidate", "item_id")
    )
    return top_n(without_seen(scored, seen), ["user_id"], score_order(), n)


def sequential_lists(last: DataFrame, probs: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
    """Most probable followers of each user's last item.

    Lists are ranked once per item, not once per user: the user only looks up the list of the last item.
    Pass ``probs`` as a table: then the ranking prunes a popular item in the scan tasks. With ``seen``,
    which differs by user, all followers of the last item take part.
    """
    if seen is not None:
        every = last.withColumnRenamed("item_id", "cur").join(probs, "cur")
        every = every.select("user_id", F.col("next").alias("item_id"), F.col("prob").alias("score"))
        return top_n(without_seen(every, seen), ["user_id"], score_order(), n)
    followers = stage_table(likeliest_next(probs, n), "likeliest-next")
    listed = last.withColumnRenamed("item_id", "cur").join(followers, "cur")
    return listed.select("user_id", F.col("next").alias("item_id"), F.col("prob").alias("score"), "rank")


def blend(legs: Mapping[str, DataFrame], weights: Mapping[str, float], key: str, n: int) -> DataFrame:
    """Weighted sum of leg scores per item, best ``n`` per key."""
    parts = [leg.select(key, "item_id", (F.col("score") * F.lit(float(weights[name]))).alias("part")) for name, leg in legs.items()]
    total = reduce(DataFrame.unionByName, parts).groupBy(key, "item_id").agg(F.sum("part").alias("score"))
    return top_n(total, [key], score_order(), n)


def blend_user_legs(legs: Mapping[str, DataFrame], n: int) -> DataFrame:
    return blend(legs, USER_LEG_WEIGHTS, "user_id", n)


def neighbors_of_recent(recent: DataFrame, vectors: DataFrame, width: int, positive_only: bool = False) -> DataFrame:
    """Neighbour lists of just the items that occur in ``recent``."""
    return knn_exact(vectors, NEIGHBORS_PER_RECENT, width, recent.select("item_id"), positive_only)


def similar_lists(neighbors: DataFrame) -> DataFrame:
    """Neighbour rows in list form, ``<item_id, similar_id, score, rank>``."""
    return neighbors.select("item_id", F.col("neighbor_id").alias("similar_id"), "score", "rank")


def blend_similar(cf: DataFrame, content: DataFrame, n: int) -> DataFrame:
    legs = {
        name: leg.select(F.col("item_id").alias("query_id"), F.col("similar_id").alias("item_id"), "score")
        for name, leg in (("cf", cf), ("content", content))
    }
    mixed = blend(legs, ITEM_LEG_WEIGHTS, "query_id", n)
    return mixed.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("similar_id"), "score", "rank")
