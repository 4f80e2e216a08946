"""TF-IDF item vectors and their reduced form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidepool.config import MAX_DIMENSIONS, MAX_TERMS
from tidepool.functions.scalars import property_phrase, tokens, unit_vector
from tidepool.session import shuffle_partitions, stage_table


def item_tokens(latest: DataFrame) -> DataFrame:
    """``<item_id, term>``, one row per token, straight from property rows.

    Phrases of one item are joined by a space, so no token spans two of them: splitting each phrase
    gives the tokens of the whole text without collecting the text of an item in one place. Rows are dealt by item
    before they become tokens: a small file that one task reads makes many tokens, and counting them per item then needs no further shuffle.
    """
    phrase = property_phrase(F.col("property"), F.col("value"))
    dealt = latest.where(F.col("value").isNotNull()).select("item_id", "property", "value").repartition(shuffle_partitions(latest.sparkSession), "item_id")
    return dealt.select("item_id", F.explode(tokens(phrase)).alias("term"))


def term_counts(item_terms: DataFrame) -> DataFrame:
    """``<item_id, term, tf>``."""
    return item_terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def default_max_features(n_docs: int) -> int:
    return min(MAX_TERMS, n_docs // 2) if n_docs > 10 else 10


def vocabulary(
    counts: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.8, max_features: int | None = None
) -> DataFrame:
    """``<term, idx, corpus_count, df, idf>``: the most frequent terms inside the document-frequency bounds.

    Equal counts are ordered by term. ``idx`` is the term's alphabetical place. The result has at most
    ``max_features`` rows (5000 by default), which makes it safe to broadcast.
    """
    size = default_max_features(n_docs) if max_features is None else max_features
    stats = counts.groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.count(F.lit(1)).alias("df"))
    inside = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    kept = inside.orderBy(F.col("corpus_count").desc(), F.col("term").asc()).limit(size)
    place = F.row_number().over(Window.orderBy("term")) - 1
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return kept.select("term", place.alias("idx"), "corpus_count", "df", idf.alias("idf"))


def tfidf_vectors(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``<item_id, term, idx, weight>`` with unit rows; items without a vocabulary term have no row.

    The norm is a window over the item, whose rows are at most the vocabulary.
    """
    raw = counts.join(F.broadcast(vocab.select("term", "idx", "idf")), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("item_id")))
    return raw.select("item_id", "term", "idx", (F.col("raw") / norm).alias("weight"))


def sparse_rows(weights: DataFrame) -> DataFrame:
    """``<item_id, vec struct<idx, w>>``: one sparse row per item, at most one entry per vocabulary term."""
    entries = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    grouped = weights.groupBy("item_id").agg(entries.alias("e"))
    return grouped.select("item_id", F.struct(F.col("e.idx").alias("idx"), F.col("e.weight").alias("w")).alias("vec"))


def _right_singular_vectors(rows: DataFrame, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and the terms x k matrix V of the sparse unit rows.

    MLlib sums the terms x terms Gram matrix in one pass; its size is set by the vocabulary (at most
    5000 terms), not by the data, so its eigenvectors are taken on the driver. A sparse MLlib vector is
    stored as a struct of type 0, size, indices and values: written in that form, it is read as one.
    """
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(n_terms).alias("size"),
        F.col("vec.idx").alias("indices"), F.col("vec.w").alias("values"),
    )
    schema = StructType([StructField("vec", VectorUDT())])
    vectors = stage_table(rows.select(stored.alias("vec")), "sparse-vectors", schema)
    gram = RowMatrix(vectors, numCols=n_terms).computeGramianMatrix().toArray()
    values, basis = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values[::-1][:k], 0.0)), basis[:, ::-1][:, :k]


def svd_item_vectors(item_terms: DataFrame, vocab: DataFrame, dimensions: int = MAX_DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """``<item_id, vec array<double>>`` = unit rows of U * Sigma, and the singular values.

    The decomposition is the uncentred one, done by MLlib on sparse rows. ``U * Sigma = A * V`` is one
    pass over the sparse rows with V (terms x k) sent to the tasks. ``item_terms`` has one row per
    token; items without a vocabulary term get no vector.
    """
    vocab = stage_table(vocab, "vocabulary")
    counts = term_counts(item_terms)
    n_terms = vocab.count()
    if n_terms == 0:
        empty = counts.select("item_id", F.array().cast("array<double>").alias("vec")).limit(0)
        return empty, np.zeros(0)
    k = min(dimensions, n_terms - 1) if n_terms > 1 else 1
    rows = stage_table(sparse_rows(tfidf_vectors(counts, vocab)), "tfidf-rows")
    sigma, v = _right_singular_vectors(rows, n_terms, k)
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            idx, w = batch.column("vec").flatten()
            starts = np.concatenate(([0], np.cumsum(idx.value_lengths().to_numpy())[:-1]))
            products = basis[idx.flatten().to_numpy()] * w.flatten().to_numpy()[:, None]
            dense = np.add.reduceat(products, starts, axis=0)
            offsets = np.arange(0, dense.size + 1, dense.shape[1], dtype=np.int32)
            vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(dense.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), vec], ["item_id", "vec"])

    item_type = rows.schema["item_id"].dataType.simpleString()
    scaled = rows.mapInArrow(project, f"item_id {item_type}, vec array<double>")
    return scaled.select("item_id", unit_vector(F.col("vec")).alias("vec")), sigma


def normalize_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", unit_vector(F.col("vec")))
