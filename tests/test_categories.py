import pytest

from tests.conftest import rows
from tidepool.operators import categories as cat

TREE = [("123", "10"), ("456", "20"), ("10", "1"), ("20", "1"), ("1", None)]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, "child string, parent string")


def _sim(df):
    return {(r.cat_a, r.cat_b): r.sim for r in df.collect()}


def test_lineage(tree):
    sim = _sim(cat.category_similarity(tree))
    assert sim[("123", "10")] == sim[("10", "123")] == 0.5
    assert sim[("123", "1")] == pytest.approx(1 / 3)
    assert ("10", "20") not in sim and ("123", "456") not in sim
    assert all(sim[(c, c)] == 1.0 for c in ("1", "10", "20", "123", "456"))


def test_common_ancestor(spark, tree):
    pairs = [("10", "20"), ("123", "456"), ("123", "20"), ("123", "123"), ("123", "lost")]
    asked = spark.createDataFrame(pairs, "cat_a string, cat_b string")
    sim = _sim(cat.common_ancestor_similarity(asked, tree))
    assert sim == pytest.approx(dict(zip(pairs, (1 / 3, 1 / 5, 1 / 4, 1.0, 0.0))))


def test_cycle_ends_and_prefers_the_forward_path(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "a"), ("d", "d")], "child string, parent string")
    sim = _sim(cat.category_similarity(ring))
    assert sim[("a", "b")] == 0.5 and sim[("b", "a")] == pytest.approx(1 / 3)
    assert sim[("d", "d")] == 1.0 and len(sim) == 10


def test_shortest_of_two_paths(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "child string, parent string")
    assert rows(cat.category_ancestors(graph)) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]


def test_nodes(tree):
    assert [c for (c,) in rows(cat.category_nodes(tree))] == ["1", "10", "123", "20", "456"]
