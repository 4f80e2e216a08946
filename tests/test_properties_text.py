import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidepool.operators import properties as prop
from tidepool.operators import textvec

A, B = 1, 2
TIMED = "item_id long, property string, value string, ts long"


def test_latest_value_whatever_the_file_order(spark):
    versions = [(A, "brand", "y", 3), (A, "brand", "x", 1), (A, "brand", "x", 2)]
    for order in (versions, versions[::-1]):
        parts = [spark.createDataFrame([v], TIMED) for v in order]
        assert rows(prop.latest_properties(parts[0].union(parts[1]).union(parts[2]))) == [(A, "brand", "y")]


def test_null_does_not_erase(spark):
    df = spark.createDataFrame([(A, "brand", "x", 1), (A, "brand", None, 2), (B, "brand", None, 1)], TIMED)
    latest = prop.latest_properties(df)
    assert {r.item_id: r.value for r in latest.collect()} == {A: "x", B: None}
    assert {r.item_id: r.text for r in prop.item_texts(latest).collect()} == {A: "brand_x", B: ""}


def test_text_and_tokens(spark):
    df = spark.createDataFrame([(A, "categoryid", "7"), (A, "brand", "Foo Bar"), (B, "brand", "z")], "item_id long, property string, value string")
    known = spark.createDataFrame([(A,)], "item_id long")
    assert rows(prop.item_texts(df, known)) == [(A, "brand_Foo Bar categoryid_7")]
    assert rows(textvec.item_tokens(prop.known_properties(df, known)).select("term")) == [("bar",), ("brand_foo",), ("categoryid_7",)]
    assert rows(prop.item_categories(df)) == [(A, "7")]


def test_tokens_split_on_unicode_white_space(spark):
    df = spark.createDataFrame([(A, "p", "a b\tc d\x1fe  f")], "item_id long, property string, value string")
    assert [t for (t,) in rows(textvec.item_tokens(df).select("term"))] == ["b", "c", "d", "e", "f", "p_a"]


def _docs(spark, term_items):
    data = [(i, term) for term, items in term_items.items() for i in items]
    return textvec.term_counts(spark.createDataFrame(data, "item_id long, term string"))


def test_vocabulary_bounds(spark):
    counts = _docs(spark, {"once": [0], "nine": range(9), "eight": range(8)})
    assert [r.term for r in textvec.vocabulary(counts, 11).collect()] == ["eight"]
    assert textvec.default_max_features(11) == 5 and textvec.default_max_features(10) == 10
    many = _docs(spark, {f"t{k}": range(2 + k % 3) for k in range(9)})
    kept = [r.term for r in textvec.vocabulary(many, 11).orderBy("idx").collect()]
    assert kept == ["t1", "t2", "t4", "t5", "t8"]


def test_tfidf_weights(spark):
    counts = _docs(spark, {"a": [0, 1], "b": [0, 1, 2], "c": [0]})
    vocab = textvec.vocabulary(counts, 4)
    idf = {t: math.log(5 / (1 + n)) + 1 for t, n in (("a", 2), ("b", 3))}
    norm = math.hypot(idf["a"], idf["b"])
    got = {(r.item_id, r.term): r.weight for r in textvec.tfidf_vectors(counts, vocab).collect()}
    assert got == pytest.approx({(0, "a"): idf["a"] / norm, (0, "b"): idf["b"] / norm, (1, "a"): idf["a"] / norm, (1, "b"): idf["b"] / norm, (2, "b"): 1.0})


def test_reduced_vectors_match_a_direct_decomposition(spark):
    draw = np.random.default_rng(3)
    data = [(int(i), f"w{t}") for i in range(60) for t in draw.choice(12, 4, replace=False)]
    terms = spark.createDataFrame(data, "item_id long, term string")
    vocab = textvec.vocabulary(textvec.term_counts(terms), 60)
    weights = textvec.tfidf_vectors(textvec.term_counts(terms), vocab).collect()
    matrix = np.zeros((60, vocab.count()))
    for r in weights:
        matrix[r.item_id, r.idx] = r.weight
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    vectors, sigma = textvec.svd_item_vectors(terms, vocab, 5)
    assert sigma == pytest.approx(s[:5])
    got = {r.item_id: np.array(r.vec) for r in vectors.collect()}
    expected = u[:, :5] * s[:5]
    expected /= np.linalg.norm(expected, axis=1, keepdims=True)
    mine = np.stack([got[i] for i in range(60)])
    assert mine @ mine.T == pytest.approx(expected @ expected.T, abs=1e-8)


def test_normalize_keeps_zero_rows(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "item_id long, vec array<double>")
    assert {r.item_id: r.vec for r in textvec.normalize_vectors(df).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_empty_vocabulary_gives_no_vectors(spark):
    terms = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, term string")
    vectors, sigma = textvec.svd_item_vectors(terms, textvec.vocabulary(textvec.term_counts(terms), 2))
    assert vectors.count() == 0 and len(sigma) == 0


def test_items_are_dealt_before_they_become_tokens(spark, tmp_path):
    """One task reads the file; none may count the tokens of all items, and the counts need no second shuffle."""
    from tidepool.sources import fixtures as fx

    parts = spark.range(40).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "int(id) AS p_size", "concat('n', id % 3) AS p_name")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    counts = textvec.term_counts(textvec.item_tokens(fx.part_properties(spark, str(tmp_path))))
    lines = counts._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(shuffles) == 1 and all(i < shuffles[0] for i, line in enumerate(lines) if "Generate" in line or "Aggregate" in line)
    assert counts.count() == 7 * 40
