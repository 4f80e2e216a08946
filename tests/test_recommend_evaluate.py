import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidepool.plans import evaluate as ev
from tidepool.plans import recommend as rec
from tidepool.plans import reports

A, B, C = 1, 2, 3


def _lists(spark, data):
    return spark.createDataFrame(data, "user_id long, item_id long, score double")


def test_repeated_recent_item_counts_twice(spark):
    recent = spark.createDataFrame([(1, A), (1, A)], "user_id long, item_id long")
    neighbors = spark.createDataFrame([(A, B, 0.4)], "item_id long, neighbor_id long, score double")
    assert rows(rec.content_lists(recent, neighbors, 10)) == [(1, B, 0.8, 1)]


def test_blend_of_three_legs(spark):
    legs = {
        "cf": _lists(spark, [(1, A, 1.0)]),
        "content": _lists(spark, [(1, A, 0.5), (1, B, 2.0)]),
        "sequential": _lists(spark, [(1, C, 1.0)]),
    }
    got = rec.blend_user_legs(legs, 10).collect()
    assert {(r.item_id, r.rank): r.score for r in got} == pytest.approx({(A, 1): 0.75, (B, 2): 0.6, (C, 3): 0.1})
    assert rec.blend_user_legs(legs, 2).count() == 2


def test_blend_of_similar_items(spark):
    cf = spark.createDataFrame([(9, A, 1.0)], "item_id long, similar_id long, score double")
    content = spark.createDataFrame([(9, A, 0.5)], "item_id long, similar_id long, score double")
    row = rec.blend_similar(cf, content, 5).first()
    assert (row.item_id, row.similar_id, row["rank"]) == (9, A, 1) and row.score == pytest.approx(0.8)


def test_cf_lists_skip_seen_items(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    items = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.5, 0.5]), (12, [0.0, 2.0])], "item_id long, vec array<double>")
    seen = spark.createDataFrame([(1, 10), (2, 11)], "user_id long, item_id long")
    asked = spark.createDataFrame([(1,), (5,)], "user_id long")
    assert rows(rec.cf_lists(users, items, seen, asked, 2, 2)) == [(1, 11, 0.5, 1), (1, 12, 0.0, 2)]


def test_hit_metrics_and_both_denominators(spark):
    held = spark.createDataFrame([(1, A), (2, A), (3, A)], "user_id long, item_id long")
    lists = spark.createDataFrame([(1, B, 1), (1, A, 2), (2, C, 1)], "user_id long, item_id long, rank int")
    items = spark.createDataFrame([(A,)], "item_id long")
    row = ev.hit_metrics(held, lists, items, 10).first()
    assert (row.hit_rate, row.mrr, row.valid_users, row.attempted_users) == (0.5, 0.25, 2, 3)
    row = ev.hit_metrics(held, lists, items, 10, count_empty=True).first()
    assert row.hit_rate == pytest.approx(1 / 3) and row.mrr == pytest.approx(1 / 6) and row.valid_users == 3
    assert ev.hit_metrics(held, lists, items, 1).first().hits == 0
    row = ev.hit_metrics(held, lists, items.limit(0), 10).first()
    assert (row.hit_rate, row.mrr, row.valid_users, row.attempted_users) == (0.0, 0.0, 0, 3)


def test_leave_one_out_keeps_copies_of_the_last_event(events):
    log = events([(1, A, "view", 1), (1, B, "view", 2), (1, B, "view", 2), (1, B, "view", 2), (2, A, "view", 1), (3, A, "view", 1), (3, C, "view", 9)])
    kept = rows(ev.leave_one_out(log).select("user_id", "item_id"))
    assert kept == [(1, A), (1, B), (1, B), (2, A), (3, A)]
    assert rows(ev.holdout_last_event(log)) == [(1, B, 4), (3, C, 2)]


def test_leave_one_out_keeps_all_columns(events):
    log = events([(1, A, "view", 1), (1, B, "view", 2)]).selectExpr("'x' AS note", "*")
    kept = ev.leave_one_out(log)
    assert kept.columns == log.columns and rows(kept.select("note", "item_id")) == [("x", A)]


def test_lists_without_seen_items(spark):
    probs = spark.createDataFrame([(A, B, 0.6), (A, C, 0.4)], "cur long, next long, prob double")
    last = spark.createDataFrame([(1, A), (2, A)], "user_id long, item_id long")
    seen = spark.createDataFrame([(1, B)], "user_id long, item_id long")
    assert rows(rec.sequential_lists(last, probs, 1, seen).select("user_id", "item_id")) == [(1, C), (2, B)]
    near = spark.createDataFrame([(A, B, 0.9), (A, C, 0.1)], "item_id long, neighbor_id long, score double")
    assert rows(rec.content_lists(last, near, 1, seen).select("user_id", "item_id")) == [(1, C), (2, B)]


def test_category_report_has_title_and_notice(spark):
    assert reports.category_report(spark, None).first().report == "Category information not available."


def test_leave_one_out_with_a_missing_event_type(events):
    log = events([(1, A, "view", 1), (1, B, None, 2)])
    assert rows(ev.leave_one_out(log).select("user_id", "item_id")) == [(1, A)]


def test_many_copies_are_restored_in_blocks(events, monkeypatch):
    monkeypatch.setattr(ev, "_COPIES_PER_STEP", 4)
    log = events([(1, A, "view", 1)] * 14)
    assert ev.leave_one_out(log).count() == 13


def _kinds(spark, data):
    return spark.createDataFrame(data, "item_id long, category string")


def test_funnel_with_zero_divisors(spark, events):
    log = events([(1, A, "addtocart", 1), (1, A, "addtocart", 2), (1, A, "transaction", 3), (1, A, "other", 4), (1, C, "view", 5)])
    row = reports.category_performance(log, _kinds(spark, [(A, "x")])).first()
    assert (row.total_interactions, row.views, row.carts, row.purchases) == (4, 0, 2, 1)
    assert (row.view_to_cart_rate, row.cart_to_purchase_rate, row.view_to_purchase_rate) == (0.0, 0.5, 0.0)


def test_funnel_report_text(spark, events):
    log = events([(1, A, "view", k) for k in range(16)] + [(1, A, "addtocart", 99), (1, B, "view", 1)])
    report = reports.category_performance_report(reports.category_performance(log, _kinds(spark, [(A, "x"), (B, "y")])))
    assert report.orderBy("position").first().line == (
        "1. Category: x\n   Total Interactions: 17\n   Views: 16\n   Add to Cart: 1\n   Purchases: 0\n"
        "   View → Cart Rate: 6.2%\n   Cart → Purchase Rate: 0.0%\n   View → Purchase Rate: 0.0%\n\n"
    )


def test_explained_lists(spark):
    lists = spark.createDataFrame([(1, A, 0.5, 1), (1, B, 0.25, 2)], "user_id long, item_id long, score double, rank int")
    near = spark.createDataFrame([(A,)], "item_id long")
    explained = reports.explain_lists(lists, _kinds(spark, [(A, "x")]), near, near)
    texts = [r.explanation for r in explained.orderBy("rank").collect()]
    assert texts[0] == (
        "1. Item: 1 (Score: 0.5000)\nCategory: x\nRecommended because:\n"
        "- Similar to items that users like you have interacted with\n"
        "- Has similar features to items you've shown interest in\n"
        "- Belongs to a category you've shown interest in\n"
    )
    assert texts[1] == "2. Item: 2 (Score: 0.2500)\nRecommended because:\n"
    asked = spark.createDataFrame([(1,), (7,)], "user_id long")
    report = {r.user_id: r.report for r in reports.user_reports(asked, explained, 5).collect()}
    assert report[1] == "Top 5 recommendations for user 1:\n\n" + texts[0] + "\n" + texts[1] + "\n"
    assert report[7] == "No recommendations could be generated for user 7."
    plain = reports.plain_lists(lists, _kinds(spark, [(A, "x")])).where("rank = 1").first().explanation
    assert plain == "1. Item: 1 (Score: 0.5000)\nCategory: x\n"


def test_unknown_method():
    with pytest.raises(ValueError):
        rec.check_method("magic", rec.USER_METHODS)


def test_popular_item_join_is_split(spark):
    """A key with a third of all rows is split by adaptive execution when both sides are tables."""
    from tidepool.session import stage_table

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        recent = spark.range(0, 30_000, 1, 8).select(
            F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5_000).cast("long").alias("item_id")
        )
        neighbors = spark.range(5_000).select(F.col("id").alias("item_id"), (F.col("id") + 1).alias("neighbor_id"), F.lit(0.5).alias("score"))
        got = rec.content_lists(stage_table(recent, "recent"), stage_table(neighbors, "neighbors"), 3)
        assert got.count() == 30_000
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
