"""Document fingerprints from closed syncmers over words; DataFrame and SQL functions only.

A k-mer of ``K`` words is an anchor if the least hash among its inner substrings of ``S`` words lies at its first or last
place. Whether a k-mer is chosen depends on its own words alone, so texts share the anchors of all passages that they
share, wherever these stand. A fingerprint keeps the ``SKETCH`` smallest 32-bit anchor hashes; the likeness of two fingerprints
estimates the share of common anchors among all anchors of both texts (exact for texts with few anchors).

Cases: a null text counts as empty; a text without words has the empty fingerprint, alike (1.0) only to another empty one;
a text of fewer than ``K`` words has one anchor, its whole sequence; repeated words give repeated anchors, which
count once; rows do not depend on each other except through their successor; ties in doc_id follow the text, rows that agree in both are
successors of each other in some order; a null doc_id is the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.common import WHITE_RUN, let, whole_text

K, S = 4, 2
SKETCH = 128
#: Rows that one bucket of neighbouring ids aims at, and the most buckets.
BUCKET_ROWS = 1000
MOST_BUCKETS = 8192
FIRST_ID = -(1 << 63)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (position, hash) of the closed syncmers of a text, by position; the hash is null at places not chosen."""
    inner = k - s + 1

    def chosen(grams: Column) -> Column:
        def pick(i: Column) -> Column:
            def closed(w: Column) -> Column:
                least = F.array_min(w)
                edge = (F.get(w, F.lit(0)) == least) | (F.get(w, F.lit(inner - 1)) == least)
                return F.struct(i.cast("int").alias("position"), F.when(edge, F.xxhash64(w)).alias("hash"))

            return let(F.slice(grams, i + 1, inner), closed)

        return F.transform(F.sequence(F.lit(0), F.size(grams) - inner), pick)

    def of(hashes: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(hashes).alias("hash")))
        none = F.filter(whole, lambda _: F.lit(False))
        grams = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - s), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(s)])
        )
        return F.when(F.size(hashes) >= k, let(grams, chosen)).when(F.size(hashes) > 0, whole).otherwise(none)

    return let(F.transform(_words(text), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, size: int = SKETCH) -> Column:
    """The smallest distinct 32-bit anchor hashes of a text, in order."""
    hashes = F.transform(F.filter(anchors(text), lambda a: a["hash"].isNotNull()), lambda a: a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def as_text(values: Column) -> Column:
    """A sketch as a string: eight lower-case hex digits a hash."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The estimated share of common anchors, from 0 to 1, of two sketches."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    shared = let(both, lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(shared, F.lit(0.0)))


def anchor_table(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, hash) of all anchors, for positional matching of passages."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.explode(anchors(whole_text(text))).alias("a"))
    return rows.select("doc_id", "a.position", "a.hash").where("hash is not null")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common anchors of two anchor tables with their distance in position: equal distances in a row are a shared passage."""
    a = left.select(F.col("doc_id").alias("left_id"), F.col("position").alias("left_position"), "hash")
    b = right.select(F.col("doc_id").alias("right_id"), F.col("position").alias("right_position"), "hash")
    both = a.join(b, "hash").where(F.col("left_id") != F.col("right_id"))
    return both.withColumn("shift", F.col("right_position") - F.col("left_position"))


def with_successor(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row that follows by descending ``key``, the first row after the last.

    The ids are cut at their quantiles into buckets; a bucket also gets the head of the following one, so that a
    window over each bucket finds every successor and a text is shuffled once. No task holds more than a bucket.
    """
    order = F.coalesce(F.col(key), F.lit(FIRST_ID))
    size = rows.select(order.alias("k")).agg(F.count("*").alias("n"), F.max("k").alias("top")).first()
    buckets = max(1, min(MOST_BUCKETS, size.n // BUCKET_ROWS))
    cuts = rows.select(order.alias("k")).agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets + 1)], 20 * buckets).alias("cuts"))
    heads = sorted({*(cuts.first().cuts or []), *([size.top] if size.n else [])})  # the largest id of each bucket
    step = max(1, int(len(heads) ** 0.5))
    coarse = heads[step - 1 :: step]
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")

    def bucket(k: Column) -> Column:
        # the number of heads below k, first in steps, then within the step
        whole = F.size(F.filter(array(coarse), lambda h: h < k)) * step
        return let(whole, lambda w: w + F.size(F.filter(F.slice(array(heads), w + 1, step), lambda h: h < k)))

    own = rows.withColumn("k", order).withColumn("bucket", bucket(F.col("k")))
    last = F.lit(max(0, len(heads) - 1))
    # a bucket's largest id closes the bucket above it, and the largest id of all closes the lowest
    above = F.when(F.col("bucket") == last, F.lit(0)).otherwise(F.col("bucket") + 1)
    is_head = F.array_contains(array(heads), F.col("k"))
    place = F.when(is_head, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(above.alias("b"), F.lit(1).alias("ghost"))))
    place = place.otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))
    spread = own.withColumn("p", F.explode(place)).select(*rows.columns, "k", "p.b", "p.ghost")
    follow = Window.partitionBy("b").orderBy("ghost", F.desc("k"), F.desc(tie))
    found = spread.select(*rows.columns, "ghost", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns])
    return found.where(F.col("ghost") == 0).drop("ghost")


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of its successor.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("t")).withColumn("own", sketch(F.col("t")))
    both = with_successor(rows, "doc_id", "t", ["t", "own"])
    n = F.length("t")
    changed = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - changed), F.substring(F.col("next_t"), F.lit(1), changed))
    # inline: each array is computed once for all the columns that use it
    texts = both.select("doc_id", "own", "next_own", n.cast("long").alias("n_chars"), F.inline(F.array(F.struct(edited.alias("e")))))
    marks = texts.select("doc_id", "own", "next_own", "n_chars", F.sha2("e", 256).alias("edited_sha256"), F.inline(F.array(F.struct(sketch(F.col("e")).alias("changed")))))
    return marks.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
