"""The streaming search kernels against brute force, and the three ways in which requests and candidates meet."""

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from tidepool.operators import neighbors as near
from tidepool.operators import search as sr

TERMS = 300


def sparse_matrix(n, seed=0, common=0.5):
    """Rows of a few rare terms; half of them also have a very common one."""
    draw = np.random.default_rng(seed)
    matrix = np.zeros((n, TERMS))
    for row in matrix:
        row[draw.integers(5, TERMS, 6)] = draw.random(6) + 0.5
        if draw.random() < common:
            row[:3] = draw.random(3) * 0.1
    matrix[n // 3 : n // 3 + n // 4] = matrix[0]  # many copies
    matrix[1] = 0
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def as_structs(matrix):
    idx = [np.flatnonzero(r).astype(np.int32) for r in matrix]
    return pa.array([{"idx": i.tolist(), "w": r[i].tolist()} for i, r in zip(idx, matrix)], pa.struct([("idx", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))]))


def as_lists(matrix):
    return pa.array(matrix.tolist(), pa.list_(pa.float64()))


def brute(matrix, ids, n, hidden=(), positive=True):
    scores = np.round(matrix @ matrix.T, 6)
    lists = []
    for i, key in enumerate(ids):
        ranked = sorted((j for j in range(len(ids)) if j != i and (key, ids[j]) not in hidden and (not positive or scores[i, j] > 0)), key=lambda j: (-scores[i, j], ids[j]))
        lists += [(key, ids[j], rank + 1) for rank, j in enumerate(ranked[:n])]
    return sorted(lists)


@pytest.mark.parametrize("names", ["numbers", "strings"])
@pytest.mark.parametrize("step", [7, 1000])
@pytest.mark.parametrize("kind", ["sparse", "dense"])
def test_kernels_equal_brute_force_in_any_batches(kind, step, names):
    matrix = sparse_matrix(200)
    ids = np.random.default_rng(3).permutation(200).tolist()
    ids = ids if names == "numbers" else [f"é{i}" for i in ids]
    hidden = {(ids[0], ids[i]) for i in range(0, 200, 3)} | {(ids[5], ids[9])}
    if kind == "sparse":
        vectors, search = as_structs(matrix), sr.SparseSearch
    else:
        vectors, search = as_lists(matrix), sr.DenseSearch
    found = search(pa.array(ids), vectors, TERMS, 5, digits=6, drop_self=True, positive_only=True)
    found.hide(pa.array([k for k, _ in hidden]), pa.array([i for _, i in hidden]))
    for at in range(0, 200, step):
        found.meet(pa.array(ids[at : at + step]), vectors[at : at + step])
    best = found.best()
    assert sorted(zip(*(best.column(c).to_pylist() for c in ("key", "item", "rank")))) == brute(matrix, ids, 5, hidden)


def test_sparse_work_is_less_than_all_postings():
    """Common terms stand in half of 4,000 rows; most requests stop before they read them."""
    matrix = sparse_matrix(4000, 4)
    vectors, ids = as_structs(matrix), pa.array(range(4000))
    found = sr.SparseSearch(ids[:400], vectors[:400], TERMS, 3, digits=6, drop_self=True, positive_only=True)
    found.meet(ids, vectors)
    all_postings = int(((matrix[:400] > 0).sum(axis=0) * (matrix > 0).sum(axis=0)).sum())
    assert found.work < 0.6 * all_postings


def test_groups_limit_the_pairs():
    matrix = sparse_matrix(60, 5)
    ids = list(range(60))
    search = sr.DenseSearch(pa.array(ids), as_lists(matrix), TERMS, 4, digits=6, drop_self=True, positive_only=True)
    half = np.arange(30)
    search.meet_groups(pa.array(ids), as_lists(matrix), [(half, half), (half + 30, half + 30), (np.arange(0), half)])
    best = search.best()
    wanted = brute(matrix[:30], ids[:30], 4) + brute(matrix[30:], ids[30:], 4)
    assert sorted(zip(*(best.column(c).to_pylist() for c in ("key", "item", "rank")))) == sorted(wanted)


def _frames(spark, matrix, ids, sparse):
    if sparse:
        data = [(i, (np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist())) for i, r in zip(ids, matrix)]
        return spark.createDataFrame(data, "item long, vec struct<idx: array<int>, w: array<double>>")
    return spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, matrix)], "item long, vec array<double>")


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("way", ["candidates", "requests", "blocks"])
def test_every_way_gives_the_same_lists(spark, monkeypatch, way, sparse):
    matrix, ids = sparse_matrix(150, 6), list(range(100, 250))
    frame = _frames(spark, matrix, ids, sparse)
    asked = frame.withColumnRenamed("item", "key")
    pairs = [(100, i) for i in range(110, 200)] + [(101, 102), (999, 100)]
    hidden = spark.createDataFrame(pairs, "key long, item long")
    if way != "candidates":
        monkeypatch.setattr(near, "_BLOCK_BYTES", 10 if way == "blocks" else 400_000)
        monkeypatch.setattr(near, "_row_bytes", lambda df, width, sp: (150, 2000.0 if "key" in df.columns else 10_000.0))
    found = near.best_matches(asked, frame, 5, TERMS, exclude=hidden, drop_self=True, positive_only=True)
    plan = found._jdf.queryExecution().toString()
    assert ("explode(sequence(0" in plan) == (way == "blocks")
    assert rows(found.select("key", "item", "rank")) == brute(matrix, ids, 5, set(pairs))


def test_requests_are_not_copied(spark, monkeypatch):
    """Where both sides are large, only candidates are dealt to every block."""
    monkeypatch.setattr(near, "_BLOCK_BYTES", 10)
    frame = _frames(spark, sparse_matrix(50, 7), list(range(50)), False)
    found = near.best_matches(frame.withColumnRenamed("item", "key"), frame, 3, TERMS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "CartesianProduct" not in plan


def test_sparse_rows_need_positive_only(spark):
    frame = _frames(spark, sparse_matrix(10, 8), list(range(10)), True)
    with pytest.raises(ValueError):
        near.best_matches(frame.withColumnRenamed("item", "key"), frame, 3, TERMS)


def test_candidates_move_once_where_one_block_holds_the_requests(spark, monkeypatch):
    monkeypatch.setattr(near, "_BLOCK_BYTES", 10)
    matrix, ids = sparse_matrix(120, 9), list(range(120))
    frame = _frames(spark, matrix, ids, False)
    asked = frame.where("item % 10 = 0").withColumnRenamed("item", "key")
    found = near.best_matches(asked, frame, 4, TERMS, drop_self=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[part#" in plan and "[block#" not in plan
    assert rows(found.select("key", "item", "rank")) == [r for r in brute(matrix, ids, 4, positive=False) if r[0] % 10 == 0]


def test_full_lists_are_compared_and_not_ranked(monkeypatch):
    matrix = np.random.default_rng(10).standard_normal((6000, 8))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[5500:] = matrix[:500]  # copies that tie with listed ones, and lower ids that win
    ids = np.random.default_rng(11).permutation(6000)
    search = sr.DenseSearch(pa.array(ids[:300]), as_lists(matrix[:300]), 8, 3, digits=6, drop_self=True, positive_only=False)
    search.meet(pa.array(ids[:3000]), as_lists(matrix[:3000]))
    monkeypatch.setattr(sr.np, "argpartition", None)
    search.meet(pa.array(ids[3000:]), as_lists(matrix[3000:]))
    best = search.best()
    scores = np.round(matrix[:300] @ matrix.T, 6)
    scores[np.arange(300), np.arange(300)] = -2
    wanted = [(ids[i], ids[j], k + 1) for i in range(300) for k, j in enumerate(np.lexsort((ids, -scores[i]))[:3])]
    assert sorted(zip(*(best.column(c).to_pylist() for c in ("key", "item", "rank")))) == sorted(wanted)


def test_many_equal_documents_offer_a_list_only(monkeypatch):
    copies = as_structs(np.tile(np.eye(1, TERMS), (3000, 1)))
    ids = np.random.default_rng(12).permutation(3000)
    search = sr.SparseSearch(pa.array([-1, -2]), copies[:2], TERMS, 4, digits=6, drop_self=True, positive_only=True)
    sizes, merge = [], search._merge
    monkeypatch.setattr(search, "_merge", lambda items, r, c, s: (sizes.append(len(r)), merge(items, r, c, s)))
    for at in range(0, 3000, 1000):
        search.offer(pa.array(ids[at : at + 1000]), copies[:1000])
    best = search.best()
    assert sizes == [8] and best.column("item").to_pylist() == [0, 1, 2, 3] * 2


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e9, 1e16])
def test_full_lists_are_compared_in_single_precision_and_lose_nothing(monkeypatch, scale):
    """Near ties closer than single precision, hidden pairs and crowded rows; few pairs are multiplied in doubles where it holds."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((40, 24))
    items = np.concatenate((rng.standard_normal((9000, 24)), centre[rng.integers(0, 40, 3000)] * (1 + 1e-9 * rng.integers(0, 3, (3000, 1)))))
    asked = np.concatenate((centre[:20], rng.standard_normal((40, 24))))
    ids, left, right = rng.permutation(len(items)), asked * scale, items / scale
    products = []
    real = sr.DenseSearch._best_of
    monkeypatch.setattr(sr.DenseSearch, "_best_of", lambda self, a, b, *rest: products.append(a.shape[0] * b.shape[1]) or real(self, a, b, *rest))

    def rows(matrix):
        return pa.array(matrix.tolist(), pa.list_(pa.float64()))

    search = sr.DenseSearch(pa.array(-1 - np.arange(len(asked))), rows(left), 24, 7, digits=6, drop_self=True, positive_only=False)
    hidden = rng.integers(0, len(asked), 500), rng.integers(0, len(items), 500)
    search.hide(pa.array(-1 - hidden[0]), pa.array(ids[hidden[1]]))
    for start in range(0, len(items), 5000):
        search.meet(pa.array(ids[start : start + 5000]), rows(right[start : start + 5000]))
    found = search.best()
    scores = left @ right.T
    order = np.rint(scores * 1e6)
    order[hidden] = -np.inf
    want = [ids[np.lexsort((ids, -row))[:7]].tolist() for row in order]
    got = [[] for _ in asked]
    for key, item in zip(found.column("key").to_pylist(), found.column("item").to_pylist(), strict=True):
        got[-1 - key].append(item)
    assert got == want
    if scale < 1e15:
        assert sum(products) < 0.5 * scores.size


def categorical(n, seed):
    """Rows of one term of each of five kinds, as a catalogue has: every posting list is long, and none holds a list's members alone."""
    draw = np.random.default_rng(seed)
    matrix, begin = np.zeros((n, TERMS)), 0
    for kinds, weight in ((25, 6.0), (6, 3.6), (50, 3.9), (8, 2.1), (8, 2.2)):
        matrix[np.arange(n), begin + draw.integers(0, kinds, n)] = weight * (1 + 0.2 * draw.random(n))
        begin += kinds
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.mark.parametrize("step", [5000, 900])
def test_documents_that_lack_too_much_are_not_multiplied(step):
    matrix, ids = categorical(5000, 13), np.random.default_rng(14).permutation(5000)
    vectors = as_structs(matrix)
    search = sr.SparseSearch(pa.array(ids[:100]), vectors[:100], TERMS, 6, digits=6, drop_self=True, positive_only=True)
    hidden = [(i, (i * 7 + j) % 5000) for i in range(50) for j in range(40)]
    search.hide(pa.array([ids[i] for i, _ in hidden]), pa.array([ids[j] for _, j in hidden]))
    for at in range(0, 5000, step):
        search.meet(pa.array(ids[at : at + step]), vectors[at : at + step])
    best = search.best()
    order = np.rint(matrix[:100] @ matrix.T * 1e6)
    order[np.arange(100), np.arange(100)] = 0
    for i, j in hidden:
        order[i, j] = 0
    wanted = [(ids[i], ids[j], k + 1) for i in range(100) for k, j in enumerate(np.lexsort((ids, -order[i]))[:6])]
    assert list(zip(*(best.column(c).to_pylist() for c in ("key", "item", "rank")))) == wanted
    assert search.work < 100 * 5000 * 0.1


def test_bounded_requests_pass_parts_by_and_lose_nothing(spark, monkeypatch):
    """Copies, a null id, an empty row and requests with fewer neighbours than a list holds."""
    matrix = categorical(400, 15)
    matrix[100:150] = matrix[7]
    matrix[[3, 4]] = 0
    matrix[3, TERMS - 1] = 1
    frame = _frames(spark, matrix, [None, *range(1, 400)], True)
    asked = frame.where("item is null or item % 9 < 4").withColumnRenamed("item", "key")
    lists = []
    for n in (4, 120):
        for way in ("candidates", "requests"):
            monkeypatch.setattr(near, "_BLOCK_BYTES", 10**6 if way == "candidates" else 25_000)
            monkeypatch.setattr(near, "_FEW_REQUESTS", 0)
            found = near.best_matches(asked, frame, n, TERMS, drop_self=True, positive_only=True)
            assert ("spot" in found._jdf.queryExecution().toString()) == (way == "requests")
            lists.append(sorted(rows(found.selectExpr("coalesce(key, -1)", "coalesce(item, -1)", "rank", "round(score, 9)"))))
    assert lists[0] == lists[1] and lists[2] == lists[3] and len(lists[0]) > 600
    search = sr.SparseSearch(pa.array([1]), as_structs(matrix[:1]), TERMS, 4, digits=6, drop_self=True, positive_only=True)
    search.bound(pa.array([0.99]))
    search.meet(pa.array(range(200)), as_structs(np.where(matrix[:1] > 0, 0, matrix[200:])))
    assert search.work == 0 and search.best() is None
