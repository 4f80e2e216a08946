"""Top-n lists per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key with their 1-based rank.

    Spark prunes to ``n`` rows per key inside every map task before the shuffle (WindowGroupLimit),
    so a key that holds most of the rows reaches its reducer as a few rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def score_order(score: str = "score", tie: str = "item_id", digits: int = 6) -> list[Column]:
    """Highest score first; scores equal to ``digits`` decimals are ordered by id."""
    return [F.round(F.col(score), digits).desc(), F.col(tie).asc()]
