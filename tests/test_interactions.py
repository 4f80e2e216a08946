import hashlib

from tests.conftest import rows
from tidepool.operators import interactions as inter


def test_weights_sum_and_unmapped_types_make_no_cell(events):
    log = events([(1, 10, "view", 1), (1, 10, "view", 2), (1, 10, "addtocart", 3), (1, 11, "wishlist", 4)])
    assert rows(inter.interaction_matrix(log)) == [(1, 10, 6.0, 3)]
    assert rows(inter.item_index(log)) == [(10, 0), (11, 1)]
    confidence = {r.event: r.confidence for r in inter.event_confidence(log).collect()}
    assert confidence == {"view": 1.0, "addtocart": 4.0, "wishlist": None}


def test_dense_index_follows_id_order_over_many_partitions(spark):
    ids = [k * 7919 % 10_007 for k in range(2_000)]
    df = spark.createDataFrame([(k,) for k in ids * 2], "user_id long").repartition(13)
    assert rows(inter.user_index(df)) == [(k, n) for n, k in enumerate(sorted(set(ids)))]


def test_dense_index_of_nothing(spark):
    assert rows(inter.user_index(spark.createDataFrame([], "user_id long"))) == []


def test_index_interactions_drops_unknown_ids(spark, events):
    log = events([(1, 10, "view", 1), (2, 11, "view", 2)])
    cells = spark.createDataFrame([(1, 10, 1.0), (9, 10, 1.0), (1, 99, 1.0)], "user_id long, item_id long, weight double")
    got = inter.index_interactions(cells, inter.user_index(log), inter.item_index(log))
    assert rows(got.select("user_id", "item_id", "user_idx", "item_idx")) == [(1, 10, 0, 0)]


def test_eligible_and_sample(events):
    log = events([(u, 1, "view", k) for u in range(20) for k in range(1 + u % 2)])
    eligible = inter.eligible_users(log)
    assert rows(eligible) == [(u, 2) for u in range(1, 20, 2)]
    expected = sorted(sorted(range(1, 20, 2), key=lambda u: hashlib.md5(f"{u}:42".encode()).hexdigest())[:4])
    assert rows(inter.sample_users(eligible.repartition(5), 4)) == [(u,) for u in expected]


def test_unseen_candidates_without_a_cross_join(events):
    log = events([(1, 10, "transaction", 1), (2, 11, "view", 1), (3, 12, "view", 1)])
    matrix = inter.interaction_matrix(log)
    offered = inter.unseen_candidates(matrix, inter.popular_items(matrix, 2))
    assert rows(offered) == [(1, 11), (2, 10), (3, 10), (3, 11)]
    plan = offered._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_summary(events):
    log = events([(1, 10, "view", 1), (2, 10, "addtocart", 1), (2, 11, "other", 2)])
    assert rows(inter.matrix_summary(log, inter.interaction_matrix(log))) == [(2, 2, 2, 5.0, 0.5)]
