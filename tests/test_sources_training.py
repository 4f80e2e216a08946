import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidepool.__main__ import parser, run
from tidepool.config import Params
from tidepool.operators import factors as fac
from tidepool.operators import interactions as inter
from tidepool.plans.evaluate import leave_one_out
from tidepool.plans.model import Model
from tidepool.plans.training import Trainer, load_model
from tidepool.session import shared_folder
from tidepool.sources import tables
from tidepool.sources.artifacts import ArtifactStore, fingerprint

SMALL = Params(factors=6, iterations=3, dimensions=4)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    draw = random.Random(11)
    lines = ["visitorid,itemid,event,timestamp"]
    for k in range(600):
        kind = draw.choice(["view", "view", "addtocart", "transaction"])
        lines.append(f"{draw.randrange(40)},{draw.randrange(30)},{kind},{1612345678000 + 1000 * k}")
    (folder / "events.csv").write_text("\n".join(lines) + "\n")
    for part in (0, 1):
        lines = ["timestamp,itemid,property,value"]
        for item in range(part, 34, 2):
            lines += [f"{1612345000000 + item},{item},categoryid,{100 + item % 4}", f"1612345000000,{item},brand,b{item % 5} c{item % 3}"]
            lines.append(f"1612345000001,{item},color,{'red' if item % 2 else ''}")
        (folder / f"properties{part + 1}.csv").write_text("\n".join(lines) + "\n")
    (folder / "tree.csv").write_text("categoryid,parentid\n100,10\n101,10\n102,20\n103,20\n10,1\n20,1\n1,\n")
    return folder


@pytest.fixture(scope="module")
def inputs(spark, files):
    return (
        tables.read_events(spark, str(files / "events.csv")),
        tables.read_properties(spark, [str(files / "properties1.csv"), str(files / "properties2.csv")]),
        tables.read_tree(spark, str(files / "tree.csv")),
    )


@pytest.fixture(scope="module")
def trained(spark, inputs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("model"))
    return folder, Trainer(spark, folder, SMALL).fit(*inputs)


def test_csv_scans(inputs):
    log, properties, tree = inputs
    first = log.orderBy("ts").first()
    assert str(first.ts) == "2021-02-03 09:47:58" and log.count() == 600
    assert properties.count() == 102 and properties.where("property = 'color' AND value IS NULL").count() == 17
    assert tree.where("parent IS NULL").count() == 1


def test_epoch_does_not_depend_on_the_session_zone(spark, files):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        first = tables.read_events(spark, str(files / "events.csv")).agg(F.min("ts").cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert first == "2021-02-03 09:47:58"


def test_seconds_and_other_column_names(spark, tmp_path):
    (tmp_path / "e.csv").write_text("who,what,how,when,extra\n1,2,view,1612345678,x\n")
    log = tables.read_events(spark, str(tmp_path / "e.csv"), "s", user="who", item="what", event="how", time="when")
    assert rows(log.select("user_id", "item_id", "event", F.col("ts").cast("string"))) == [(1, 2, "view", "2021-02-03 09:47:58")]
    with pytest.raises(ValueError):
        tables.read_events(spark, str(tmp_path / "e.csv"))


def test_bad_cells_are_left_out_and_listed(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    (tmp_path / "bad.csv").write_text("timestamp,visitorid,event,itemid\n1612345678000,1,view,2\nyesterday,x,view,3\n1612345678000,,view,4\n1612345678000,5,view,6.5\n")
    assert rows(tables.read_events(spark, path).select("item_id")) == [(2,), (4,)]
    bad = tables.quarantined(spark, path, tables.events_schema())
    assert rows(bad.select("column", "value")) == [("itemid", "6.5"), ("timestamp", "yesterday"), ("visitorid", "x")]
    assert bad.select("line").distinct().count() == 2 and bad.where(F.col("line").contains("yesterday")).count() == 2


def test_one_property_file_in_two_parts_is_the_same(spark, files, inputs):
    whole = inputs[1]
    swapped = tables.read_properties(spark, [str(files / "properties2.csv"), None, str(files / "properties1.csv")])
    assert fingerprint(whole) == fingerprint(swapped.repartition(5))
    assert fingerprint(whole) != fingerprint(whole.limit(101))
    assert tables.read_properties(spark, [None, None]) is None


def test_index_is_saved_reused_and_answers_one_item(spark, inputs, tmp_path):
    params = dataclasses.replace(SMALL, neighbor_search="index")
    model = Trainer(spark, str(tmp_path), params).fit(*inputs)
    again = Trainer(spark, str(tmp_path), params)
    again.fit(*inputs)
    assert {"index_nodes", "index_entries", "index_homes"} <= set(again.store.reused)
    loaded = load_model(spark, str(tmp_path))
    items = loaded.tables["item_index"].select("item_id")
    exact = Model(SMALL, {k: v for k, v in model.tables.items() if not k.startswith("index_")}, model.summary)
    assert loaded.summary["index"]["recall"] >= 0.95
    wanted = rows(exact.item_neighbors(items, 3).select("item_id", "neighbor_id", "rank"))
    assert rows(loaded.item_neighbors(items, 3).select("item_id", "neighbor_id", "rank")) == wanted
    assert rows(loaded.get_item_neighbors(1, 3).select("item_id", "neighbor_id", "rank")) == [w for w in wanted if w[0] == 1]


def test_two_writers_lose_no_commit(spark, tmp_path):
    """The second writer looked before the first one wrote: its numbers are taken, so it goes on to the next."""
    first, second = ArtifactStore(spark, str(tmp_path)), ArtifactStore(spark, str(tmp_path))
    second._numbers = lambda name: []
    assert [first.write_record("part", {"by": 1, "n": n}) for n in range(3)] == [1, 2, 3]
    assert second.write_record("part", {"by": 2}) == 4 and first.write_record("part", {"by": 1, "n": 3}) == 5
    assert second.write_record("part", {"by": 2}) == 6
    assert [first._entry("part", n)["by"] for n in range(1, 7)] == [1, 1, 1, 2, 1, 2] and first.read_record("part") == {"by": 2}


def test_a_writer_that_dies_leaves_the_last_state(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    first = store.save("part", spark.range(3), "one")
    (tmp_path / "part.log" / "000000000002.json").write_text('{"fingerprint": "half')
    spark.range(9).write.parquet(str(tmp_path / "part" / "unfinished"))
    assert store.read_record("part")["fingerprint"] == "one" and store.read("part").count() == 3
    store.save("part", spark.range(5), "two")
    assert store.read("part").count() == 5 and first.count() == 3  # an open reader keeps its version
    assert len(store.collect_garbage("part", keep=2)) == 0  # the unfinished one may still be in the writing
    assert len(store.collect_garbage("part", keep=1, grace_seconds=0)) == 2
    assert store.read("part").count() == 5 and len(store._names("part")) == 1


def test_saved_model_answers_like_the_trained_one(spark, inputs, trained):
    folder, model = trained
    loaded = load_model(spark, folder)
    assert loaded.params == model.params and loaded.summary == model.summary
    assert set(loaded.tables) == set(model.tables)
    asked = inputs[0].select("user_id")
    assert rows(loaded.recommend(asked, 5)) == rows(model.recommend(asked, 5))
    items = inputs[0].select("item_id")
    for method in ("cf", "content", "hybrid"):
        assert rows(loaded.similar_items(items, 4, method)) == rows(model.similar_items(items, 4, method))


def test_unfinished_model_is_not_loaded(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path))


def test_reuse_needs_the_same_inputs_and_parameters(spark, inputs, trained):
    folder, _ = trained
    again = Trainer(spark, folder, SMALL)
    again.fit(*inputs)
    assert set(again.store.reused) == set(again.tables)
    other = Trainer(spark, folder, Params(factors=6, iterations=2, dimensions=4))
    other.fit(*inputs)
    assert set(other.tables) - set(other.store.reused) == {"user_factors", "item_factors"}
    fewer = Trainer(spark, folder, SMALL)
    fewer.fit(inputs[0].where("user_id > 3"), inputs[1], inputs[2])
    assert set(fewer.store.reused) == {"latest_properties", "item_categories", "category_nodes", "category_similarity"}
    fresh = Trainer(spark, folder, SMALL, reuse=False)
    fresh.fit(*inputs)
    assert fresh.store.reused == []


def test_lists_are_ranked_without_gaps_and_cf_is_unseen(inputs, trained):
    log, model = inputs[0], trained[1]
    users = log.select("user_id").unionByName(log.selectExpr("user_id + 1000 AS user_id").limit(3))
    for method in ("cf", "content", "sequential", "hybrid"):
        lists = model.recommend(users, 6, method)
        per_user = {}
        for r in lists.collect():
            per_user.setdefault(r.user_id, []).append((r["rank"], -round(r.score, 6), r.item_id))
        assert per_user and max(per_user) < 1000
        for ranked in per_user.values():
            ranked.sort()
            assert [r[0] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) <= 6
            assert [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)
    seen = model.tables["matrix"].select("user_id", "item_id")
    assert model.recommend(users, 6, "cf").join(seen, ["user_id", "item_id"]).count() == 0
    with pytest.raises(ValueError):
        model.recommend(users, 5, "magic")


def test_cf_score_is_the_dot_product(inputs, trained):
    t = trained[1].tables
    lists = trained[1].recommend(inputs[0].select("user_id"), 5, "cf")
    joined = lists.join(t["user_factors"].withColumnRenamed("vec", "x"), "user_id").join(t["item_factors"].withColumnRenamed("vec", "y"), "item_id")
    for r in joined.collect():
        assert r.score == pytest.approx(sum(a * b for a, b in zip(r.x, r.y)))


def test_hybrid_is_the_blend_of_its_legs(inputs, trained):
    users = inputs[0].select("user_id")
    total = {}
    for method, weight in (("cf", 0.6), ("content", 0.3), ("sequential", 0.1)):
        for r in trained[1].recommend(users, 5, method).collect():
            total[r.user_id, r.item_id] = total.get((r.user_id, r.item_id), 0) + weight * r.score
    for r in trained[1].recommend(users, 5, "hybrid").collect():
        assert r.score == pytest.approx(total[r.user_id, r.item_id])


def test_single_ids_and_unknown_ids(trained):
    model = trained[1]
    assert rows(model.recommend_for_user(3, 4)) == rows(model.recommend(model.tables["user_index"], 4).where("user_id = 3"))
    assert model.get_similar_items(5, 4, "cf").count() == 4 and model.get_item_neighbors(5, 3).count() == 3
    assert model.recommend_for_user(-1).count() == 0 and model.get_similar_items(-1).count() == 0


def test_forest_search_in_a_model(spark, inputs, trained):
    import dataclasses

    exact = trained[1]
    forest = dataclasses.replace(exact, params=dataclasses.replace(exact.params, neighbor_search="forest"))
    items = inputs[0].select("item_id")
    assert rows(forest.similar_items(items, 4, "content").select("item_id", "similar_id")) == rows(
        exact.similar_items(items, 4, "content").select("item_id", "similar_id")
    )


def test_evaluation_and_reports(inputs, trained):
    log, model = inputs[0], trained[1]
    row = model.evaluate(log, 5).first()
    assert row.attempted_users == 40 and 0 <= row.mrr <= row.hit_rate <= 1
    assert model.evaluate(log, 5, n_users=7).first().attempted_users == 7
    report = model.user_reports(log.where("user_id = 3").select("user_id"), 2).first().report
    assert report.startswith("Top 2 recommendations for user 3:\n\n1. Item: ") and "Recommended because:\n- Similar" in report
    assert model.category_performance(log).agg(F.sum("total_interactions")).first()[0] == 600


def test_cf_cannot_hit_in_sample_but_can_when_held_out(spark, inputs, trained, tmp_path):
    log = inputs[0]
    assert trained[1].evaluate(log, 10, method="cf").first().hits == 0
    held_out = Trainer(spark, str(tmp_path), SMALL).fit_simple(leave_one_out(log))
    assert held_out.evaluate(log, 10, method="cf").first().hits > 0
    assert held_out.recommend(log.select("user_id"), 3, "content").count() == 0
    assert held_out.recommend(log.select("user_id"), 3).count() == 120
    assert held_out.get_item_neighbors(5).count() == 0 and held_out.category_performance(log).count() == 0


def test_loss_falls_and_matches_the_full_sum(spark, inputs):
    matrix = inter.interaction_matrix(inputs[0])
    users, items = inter.user_index(inputs[0]), inter.item_index(inputs[0])
    losses = []
    for iterations in (1, 3, 8):
        x, y = fac.als_factors(matrix, users, items, 6, iterations, 0.01)
        losses.append(fac.als_training_loss(matrix, x, y, 0.0).first().loss)
    assert losses[0] > losses[1] > losses[2]
    cells = {(r.user_id, r.item_id): r.weight for r in matrix.collect()}
    xs, ys = {r.user_id: r.vec for r in x.collect()}, {r.item_id: r.vec for r in y.collect()}
    full = 0.0
    for u, xv in xs.items():
        for i, yv in ys.items():
            s, w = sum(a * b for a, b in zip(xv, yv)), cells.get((u, i))
            full += s * s if w is None else (1 + w) * (1 - s) ** 2
    assert losses[2] == pytest.approx(full, rel=1e-9)


def test_exact_confidence_treats_weight_as_confidence(spark):
    """Rank 1 on a 3 x 3 example: the item factors solve the weighted normal equations."""
    data = [(0, 0, 1.0), (0, 1, 4.0), (1, 1, 10.0), (1, 2, 1.0), (2, 0, 4.0), (2, 2, 1.0)]
    matrix = spark.createDataFrame(data, "user_id long, item_id long, weight double")
    users, items = inter.user_index(matrix), inter.item_index(matrix)
    x, y = fac.als_factors(matrix, users, items, 1, 30, 1e-6, confidence="exact")
    xs, ys = {r.user_id: r.vec[0] for r in x.collect()}, {r.item_id: r.vec[0] for r in y.collect()}
    cells = {(u, i): w for u, i, w in data}
    for u, xv in xs.items():
        top = sum(cells[u, i] * ys[i] for i in ys if (u, i) in cells)
        bottom = sum(cells.get((u, i), 1.0) * ys[i] ** 2 for i in ys)
        assert xv == pytest.approx(top / bottom, rel=2e-2)


def test_command_line(spark, files, tmp_path, capsys):
    full = ["--events", str(files / "events.csv"), "--properties1", str(files / "properties1.csv"), "--categories", str(files / "tree.csv")]
    model = run(spark, parser().parse_args([*full, "--output", str(tmp_path / "m"), "--factors", "4", "--iterations", "2"]))
    assert model.summary["has_content"] and model.summary["has_sequential"] and model.summary["n_users"] == 40
    model = run(spark, parser().parse_args(["--events", str(files / "events.csv"), "--output", str(tmp_path / "s"), "--simple", "--no-reuse"]))
    assert not model.summary["has_sequential"] and model.summary["factors"] == 50
    assert capsys.readouterr().out.count("Top 5 recommendations for user 0:") == 2


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/") in shared_folder(spark)
    assert shared_folder(spark) == shared_folder(spark)


def test_loss_sends_vectors_per_block_and_not_per_cell(spark, monkeypatch):
    """Several blocks and parts, a user with two vectors, ids without a vector or null: the sums are those of the joins."""
    draw = np.random.default_rng(20)
    monkeypatch.setattr(fac, "_BLOCK_BYTES", 200)
    users = [(u, draw.standard_normal(4).tolist()) for u in [*range(30), 3]]
    items = [(i, draw.standard_normal(4).tolist()) for i in range(20)]
    cells = [(u, i, float(1 + (u * i) % 5)) for u in range(33) for i in range(22) if (u + i) % 3] + [(None, 1, 2.0), (1, None, 2.0)]
    x, y = (spark.createDataFrame(v, f"{k} long, vec array<double>") for v, k in ((users, "user_id"), (items, "item_id")))
    found = fac.als_training_loss(spark.createDataFrame(cells, "user_id long, item_id long, weight double"), x, y, 0.5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    gram = lambda rows: np.array([v for _, v in rows]).T @ np.array([v for _, v in rows])
    fit, n = float((gram(users) * gram(items)).sum()), 0
    for u, i, w in cells:
        for s in [np.dot(v, t) for k, v in users if k == u for j, t in items if j == i]:
            fit, n = fit + (1 + w) * (1 - s) ** 2 - s**2, n + 1
    squares = sum(np.dot(v, v) for rows_, at in ((users, 0), (items, 1)) for k, v in rows_ for c in cells if c[at] == k)
    got = found.first()
    assert got.n_cells == n and got.fit == pytest.approx(fit, rel=1e-9) and got.penalty == pytest.approx(0.5 * squares, rel=1e-9)
