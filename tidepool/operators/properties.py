"""Item properties: newest values, texts, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import CATEGORY_PROPERTY
from tidepool.functions.scalars import property_phrase


def _version(properties: DataFrame):
    names = [name for name in ("ts", "tb1", "tb2") if name in properties.columns]
    return F.struct(*names, "value")


def latest_properties(properties: DataFrame) -> DataFrame:
    """``<item_id, property, value>`` with the newest non-null value of each property.

    A null never erases an older value; a property that only ever was null keeps a null. A table
    without a ``ts`` column is returned as it is.
    """
    if "ts" not in properties.columns:
        return properties.select("item_id", "property", "value")
    version = F.when(F.col("value").isNotNull(), _version(properties))
    return properties.groupBy("item_id", "property").agg(F.max_by("value", version).alias("value"))


def item_categories(latest: DataFrame) -> DataFrame:
    """``<item_id, category>``, one row per item, not limited to items with events."""
    rows = latest.where((F.col("property") == CATEGORY_PROPERTY) & F.col("value").isNotNull())
    return rows.groupBy("item_id").agg(F.max("value").alias("category"))


def known_properties(latest: DataFrame, items: DataFrame) -> DataFrame:
    return latest.join(items.select("item_id"), "item_id", "left_semi")


def item_texts(latest: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``<item_id, text>``: ``property_value`` phrases in property order, joined by spaces.

    The array per item holds one entry per property of that item. Token statistics do not need it:
    see ``item_tokens`` in ``textvec``, which works on single property rows.
    """
    rows = latest if items is None else known_properties(latest, items)
    entries = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("property", "value"))))
    phrases = F.transform("entries", lambda e: property_phrase(e["property"], e["value"]))
    grouped = rows.groupBy("item_id").agg(entries.alias("entries"))
    return grouped.select("item_id", F.array_join(phrases, " ").alias("text"))
