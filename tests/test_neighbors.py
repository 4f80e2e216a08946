import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidepool.operators import neighbors as near
from tidepool.operators import search
from tidepool.operators.textvec import normalize_vectors

WIDTH = 16


def _frame(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)], "item_id long, vec array<double>")


def brute_force(matrix, n):
    scores = np.round(matrix @ matrix.T, 6)
    lists = {}
    for i in range(len(matrix)):
        others = [j for j in range(len(matrix)) if j != i]
        lists[i] = sorted(others, key=lambda j: (-scores[i, j], j))[:n]
    return lists


def _lists(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.item_id, {})[r.rank] = r.neighbor_id
    return {i: [ranked[k] for k in sorted(ranked)] for i, ranked in found.items()}


@pytest.fixture(scope="module")
def unit():
    matrix = np.random.default_rng(5).standard_normal((300, WIDTH))
    matrix[200:] = matrix[0]  # a third are copies of one vector
    matrix[10] = 0
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def test_exact_matches_brute_force_in_any_tiling(spark, unit, monkeypatch):
    df, expected = _frame(spark, unit), brute_force(unit, 7)
    assert _lists(near.knn_exact(df, 7, WIDTH)) == expected
    monkeypatch.setattr(near, "_TASKS_PER_CORE", 5)
    monkeypatch.setattr(search, "_SLICE_CELLS", 64)
    assert _lists(near.knn_exact(df, 7, WIDTH)) == expected


def test_wide_scores_take_the_sorting_path(spark, unit):
    big = _frame(spark, unit * 1e7)
    assert _lists(near.knn_exact(big, 5, WIDTH)).keys() == brute_force(unit, 5).keys()
    draw = np.random.default_rng(1).standard_normal((40, WIDTH)) * 1e6
    assert _lists(near.knn_exact(_frame(spark, draw), 5, WIDTH)) == brute_force(draw, 5)


def test_requests_limit_the_search(spark, unit):
    asked = spark.createDataFrame([(3,), (3,), (999,)], "item_id long")
    assert _lists(near.knn_exact(_frame(spark, unit), 4, WIDTH, asked)) == {3: brute_force(unit, 4)[3]}


def test_zero_vector_scores_zero(spark, unit):
    scores = near.knn_exact(_frame(spark, unit), 5, WIDTH).where("item_id = 10").select("score")
    assert rows(scores) == [(0.0,)] * 5


def test_sparse_rows_and_positive_only(spark):
    data = [(1, ([0, 1], [0.6, 0.8])), (2, ([1], [1.0])), (3, ([2], [1.0]))]
    df = spark.createDataFrame(data, "item_id long, vec struct<idx: array<int>, w: array<double>>")
    got = near.knn_exact(df, 5, 3, positive_only=True)
    assert rows(got) == [(1, 2, 0.8, 1), (2, 1, 0.8, 1)]


def test_excluded_pairs_are_replaced_not_lost(spark):
    matrix = np.eye(4) + 0.01 * np.arange(4)
    req = _frame(spark, matrix[:2]).selectExpr("item_id AS key", "vec")
    cand = _frame(spark, matrix).selectExpr("item_id AS item", "vec")
    seen = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (1, 77), (88, 1)], "key long, item long")
    got = near.best_matches(req, cand, 2, 4, exclude=seen).select("key", "item", "rank")
    assert rows(got) == [(0, 2, 1), (1, 1, 1), (1, 3, 2)]


def test_string_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "item_id string, vec array<double>")
    assert rows(near.knn_exact(df, 1, 2).select("item_id", "neighbor_id")) == [("a", "b"), ("b", "a"), ("c", "a")]


def test_forest_with_one_leaf_is_exact_even_with_copies(spark, unit):
    got = near.knn_forest(_frame(spark, unit), 7, trees=1, leaf_rows=10_000)
    assert _lists(got) == brute_force(unit, 7)


def test_forest_recall_with_small_leaves(spark):
    centers = np.random.default_rng(2).standard_normal((20, WIDTH))
    matrix = centers.repeat(100, axis=0) + 0.3 * np.random.default_rng(3).standard_normal((2000, WIDTH))
    df = normalize_vectors(_frame(spark, matrix))
    exact = near.knn_exact(df, 10, WIDTH)
    found = near.knn_forest(df, 10, trees=16, leaf_rows=128)
    assert near.recall(found, exact).first().recall > 0.9
    assert found.groupBy("item_id").count().where("count <> 10").count() == 0


def _dense_cluster(spark):
    """A third of the vectors lie far from the mean and almost in one direction."""
    draw = np.random.default_rng(4)
    matrix = draw.standard_normal((1200, WIDTH))
    matrix[:400] = 5 + 1e-3 * draw.standard_normal((400, WIDTH))
    return normalize_vectors(_frame(spark, matrix))


def test_dense_cluster_is_split_like_anything_else(spark):
    distinct = _dense_cluster(spark).withColumnRenamed("item_id", "rep")
    leaves = near._grow_forest(distinct, 1200, WIDTH, 3, 20, 1)
    assert leaves.groupBy("tree").agg(F.countDistinct("rep").alias("n"), F.count("*").alias("m")).select("n", "m").distinct().collect() == [(1200, 1200)]
    assert leaves.groupBy("tree", "depth", "leaf").count().agg(F.max("count")).first()[0] <= 40


def test_leaves_that_stay_full_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(near, "_SPLIT_ROUNDS", 0)
    df = _dense_cluster(spark)
    exact = near.knn_exact(df, 3, WIDTH)
    found = near.knn_forest(df, 3, trees=1, leaf_rows=16)
    assert rows(found.select("item_id", "neighbor_id", "rank")) == rows(exact.select("item_id", "neighbor_id", "rank"))


def test_angular(spark, unit):
    got = near.with_angular(near.knn_exact(_frame(spark, unit), 3, WIDTH)).collect()
    for r in got:
        assert r.angular == pytest.approx(1 - np.sqrt(max(0.0, 2 * (1 - r.score))) / 2)


def test_empty_input(spark, unit):
    none = _frame(spark, unit).limit(0)
    assert near.knn_exact(none, 3, WIDTH).count() == 0
    assert near.knn_forest(none, 3).count() == 0
