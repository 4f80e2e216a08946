import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidepool.operators import sequences as seq
from tidepool.operators.stitched import followers, places, stitch
from tidepool.plans.recommend import sequential_lists

A, B, C = 1, 2, 3
ORDER = ["ts", "item_id", "event"]


def test_transition_counts_and_probabilities(events):
    log = events([(1, A, "view", 1), (1, B, "view", 2), (1, A, "view", 3), (1, B, "view", 4), (1, C, "view", 5), (2, A, "view", 1)])
    counts = seq.transition_counts(log)
    assert rows(counts) == [(A, B, 2), (B, A, 1), (B, C, 1)]
    assert rows(seq.transition_probs(counts).select("cur", "next", "prob")) == [(A, B, 1.0), (B, A, 0.5), (B, C, 0.5)]
    assert (2, 1, A) in rows(seq.user_sequences(log))


def test_self_transition(events):
    log = events([(1, A, "view", 1), (1, A, "view", 2), (1, B, "view", 3)])
    assert rows(seq.transition_probs(seq.transition_counts(log)).select("cur", "next", "prob")) == [(A, A, 0.5), (A, B, 0.5)]


@pytest.fixture(scope="module")
def skewed(events):
    """One user with a third of all rows, and ties in time."""
    draw = random.Random(7)
    busy = [(0, draw.randrange(6), "view", draw.randrange(60)) for _ in range(120)]
    others = [(1 + k % 60, draw.randrange(6), "view", draw.randrange(60)) for k in range(240)]
    return busy + others


def brute_force(log):
    history = {}
    for user, item, event, second in sorted(log, key=lambda r: (r[0], r[3], r[1], r[2])):
        history.setdefault(user, []).append(item)
    pairs = {}
    for items in history.values():
        for pair in zip(items, items[1:]):
            pairs[pair] = pairs.get(pair, 0) + 1
    return history, pairs


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_any_ranges_give_whole_results(events, skewed, ranges):
    walked = stitch(events(skewed), "user_id", "item_id", ORDER, ranges)
    history, pairs = brute_force(skewed)
    assert rows(places(walked)) == sorted((u, i, p) for u, items in history.items() for p, i in enumerate(items, 1))
    assert rows(followers(walked).groupBy("cur", "next").count()) == sorted((a, b, n) for (a, b), n in pairs.items())


def test_a_user_with_half_of_all_rows_at_one_time_is_spread(events):
    """Equal keys, times and items: only the tie can part them."""
    log = [(7, A, "view", 5)] * 300 + [(7, B, "view", 5)] * 100 + [(k, C, "view", k % 3) for k in range(400)]
    walked = stitch(events(log), "user_id", "item_id", ORDER, 16)
    sizes = walked.rows.where("key = 7").groupBy("part").count()
    assert sizes.count() >= 6 and sizes.agg(F.max("count")).first()[0] <= 120
    history, pairs = brute_force(log)
    assert rows(places(walked)) == sorted((u, i, p) for u, items in history.items() for p, i in enumerate(items, 1))
    assert rows(followers(walked).groupBy("cur", "next").count()) == sorted((a, b, n) for (a, b), n in pairs.items())


def test_null_users_and_items_and_no_rows(spark, events):
    frame = spark.createDataFrame([(None, 1, 1), (None, None, 2), (None, 3, 3), (5, 4, 1)], "user_id long, item_id long, ts int")
    walked = stitch(frame, "user_id", "item_id", ["ts"], 2)
    assert rows(followers(walked).where("cur IS NULL")) == [(None, 3)]
    assert sorted(places(walked).select("place").toPandas()["place"]) == [1, 1, 2, 3]
    assert rows(seq.user_sequences(events([]))) == [] == rows(seq.transition_counts(events([])))


def test_row_order_and_partitions_do_not_matter(events, skewed):
    shuffled = list(skewed)
    random.Random(1).shuffle(shuffled)
    assert rows(seq.transition_counts(events(shuffled).repartition(7))) == rows(seq.transition_counts(events(skewed).coalesce(1)))


def test_recent_and_last(events):
    log = events([(1, k, "view", k) for k in range(1, 8)] + [(2, A, "view", 1), (2, A, "view", 2)])
    recent = rows(seq.recent_items(log, 5))
    assert [r for r in recent if r[0] == 1] == [(1, 3, 5), (1, 4, 4), (1, 5, 3), (1, 6, 2), (1, 7, 1)]
    assert [r for r in recent if r[0] == 2] == [(2, A, 1), (2, A, 2)]
    assert rows(seq.last_items(log)) == [(1, 7), (2, A)]


def test_sequential_lists_rank_by_probability_then_id(events):
    log = events([(1, A, "view", 1), (1, C, "view", 2), (2, A, "view", 1), (2, B, "view", 2), (3, C, "view", 1), (3, A, "view", 2)])
    probs = seq.transition_probs(seq.transition_counts(log))
    got = rows(sequential_lists(seq.last_items(log), probs, 5))
    assert got == [(1, A, 1.0, 1), (3, B, 0.5, 1), (3, C, 0.5, 2)]


def test_top_n_is_pruned_before_the_shuffle(events):
    log = events([(1, A, "view", 1)])
    plan = seq.recent_items(log, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
