"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are identical without white space; SHA-256 of that form stands for the text.
Misra-Gries summaries of the partitions name the digests that may be frequent, an exact count verifies
them, and the verified winners (at most ``counters`` rows) are broadcast, so that their copies are settled
on the map side. All other digests, each below 2 / (counters + 1) of the rows, take an ordinary shuffle.

Cases: null text counts as empty, and empty texts are copies of each other; the row with most code points in
the original text stays, then the one with the smallest doc_id, a null doc_id last; of rows that agree in all
of this one stays. An empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.common import WHITE, small_batches, spare, whole_text
from tidepool.session import stage_table

COUNTERS = 1000


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text without its white space."""

    @F.pandas_udf("binary")
    def digest(texts):
        return texts.map(lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, WHITE)).digest())

    return digest(text)


def _reduce(counts: Counter, counters: int) -> None:
    """Misra-Gries: take the (counters + 1)-th largest count from all, drop what falls to nothing."""
    if len(counts) > counters:
        least = sorted(counts.values(), reverse=True)[counters]
        for key in list(counts):
            counts[key] -= least
            if counts[key] <= 0:
                del counts[key]


def frequent_candidates(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` keys, among them every one with more than 2 / (counters + 1) of the rows.

    Each partition keeps at most twice ``counters`` keys in memory and hands on ``counters``; their sums are merged by
    an ordinary aggregation.
    """

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            if len(counts) > 2 * counters:
                _reduce(counts, counters)
        _reduce(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
        )

    parts = df.select(F.col(key).alias("key")).mapInArrow(summarise, "key binary, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(counters).select("key")


def _order(chars: str, doc: str) -> list[Column]:
    """Numbers that are smaller the better a row's claim to stay."""
    return [(-F.col(chars)).alias("c"), F.col(doc).isNull().alias("u"), F.col(doc).alias("d")]


def _verified(rows: DataFrame, counters: int) -> DataFrame:
    """The frequent digests with exact size and claim; ``rows`` has digest and claim."""
    candidates = F.broadcast(frequent_candidates(rows, "digest", counters).withColumnRenamed("key", "digest"))
    found = rows.join(candidates, "digest").groupBy("digest").agg(F.count("*").alias("size"), F.min("claim").alias("best"))
    return found.where(F.col("size") > 1)


def exact_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    small_batches(docs.sparkSession)
    body = whole_text(text)
    rows = docs.select(F.col(doc).alias("d"), F.length(body).alias("chars"), text_digest(body).alias("digest"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = rows.select("d", "row", "digest", F.struct(*_order("chars", "d"), F.col("row").alias("r")).alias("claim"))
    heavy = F.broadcast(stage_table(_verified(rows, counters), "heavy"))
    split = rows.join(heavy, "digest", "left")
    group = Window.partitionBy("digest")
    light = split.where(F.col("size").isNull()).select("d", "row", "digest", "claim")
    light = light.withColumn("size", F.count("*").over(group)).withColumn("best", F.min("claim").over(group))
    both = light.unionByName(split.where(F.col("size").isNotNull()).select(*light.columns))
    return both.select(
        F.col("d").alias("doc_id"), F.col("best.d").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.r")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    Copies of frequent texts go on the map side; only their best rows and all infrequent texts are shuffled.
    """
    small_batches(docs.sparkSession)
    body = whole_text(text)
    key, claim, place = spare(docs, "digest"), spare(docs, "claim"), spare(docs, "place")
    chars = F.length(body)
    brief = docs.select(F.col(doc).alias("d"), chars.alias("chars"), text_digest(body).alias("digest"))
    brief = stage_table(brief.select("digest", F.struct(*_order("chars", "d")).alias("claim")), "digests")
    heavy = _verified(brief, counters).select(F.col("digest").alias("heavy_digest"), F.col("best").alias("heavy_best"))
    heavy = stage_table(heavy, "heavy")
    marked = docs.withColumn(key, text_digest(body)).withColumn(
        claim, F.struct((-chars).alias("c"), F.col(doc).isNull().alias("u"), F.col(doc).alias("d"))
    )
    heavy = heavy.select(F.col("heavy_digest").alias(spare(marked, "heavy_digest")), F.col("heavy_best").alias(spare(marked, "heavy_best")))
    name, best = heavy.columns
    left = marked.join(F.broadcast(heavy), F.col(key) == F.col(name), "left")
    left = left.where(F.col(best).isNull() | F.col(claim).eqNullSafe(F.col(best)))
    first = Window.partitionBy(key).orderBy(claim)
    return left.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])


