"""Time-ordered user histories and first-order item transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.ranking import top_n
from tidepool.operators.stitched import followers, places, stitch
from tidepool.session import stage_table

_ORDER = ("ts", "tb1", "tb2", "item_id", "event")


def event_order(events: DataFrame) -> list[str]:
    """Columns that order a user's events: time, then whatever tie-breaks the table has."""
    return [name for name in _ORDER if name in events.columns]


def event_key(events: DataFrame):
    return F.struct(*event_order(events))


def user_sequences(events: DataFrame) -> DataFrame:
    """``<user_id, pos, item_id>``, pos from 1 in time order; all event types, repeats kept."""
    walked = stitch(events, "user_id", "item_id", event_order(events))
    return places(walked).select(F.col("key").alias("user_id"), F.col("place").alias("pos"), F.col("value").alias("item_id"))


def adjacent_pairs(events: DataFrame) -> DataFrame:
    """One ``<cur, next>`` row per two consecutive events of a user."""
    return followers(stitch(events, "user_id", "item_id", event_order(events)))


def transition_counts(events: DataFrame) -> DataFrame:
    """``<cur, next, n>``; a self-transition counts like any other."""
    return adjacent_pairs(events).groupBy("cur", "next").agg(F.count(F.lit(1)).alias("n"))


def transition_probs(counts: DataFrame) -> DataFrame:
    """``<cur, next, n, prob>``.

    Totals are joined back instead of taken over a window, so a popular ``cur`` is never one task:
    totals aggregate map-side, and the join of two tables is split by adaptive execution.
    """
    counts = stage_table(counts, "transition-counts")
    totals = stage_table(counts.groupBy("cur").agg(F.sum("n").alias("total")), "transition-totals")
    return counts.join(totals, "cur").select("cur", "next", "n", (F.col("n") / F.col("total")).alias("prob"))


def likeliest_next(probs: DataFrame, n: int) -> DataFrame:
    """The ``n`` most probable followers of each item, with rank."""
    return top_n(probs, ["cur"], [F.col("n").desc(), F.col("next").asc()], n)


def recent_items(events: DataFrame, m: int) -> DataFrame:
    """``<user_id, item_id, recency>``: the last ``m`` events of each user, 1 = newest, repeats kept."""
    newest_first = [F.col(name).desc() for name in event_order(events)]
    return top_n(events, ["user_id"], newest_first, m, rank="recency").select("user_id", "item_id", "recency")


def last_items(events: DataFrame) -> DataFrame:
    """``<user_id, item_id>`` of each user's newest event."""
    return events.groupBy("user_id").agg(F.max_by("item_id", event_key(events)).alias("item_id"))
