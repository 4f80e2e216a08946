"""Searches of the entry answer every known id, as their SQL does."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract

TABLES = ("lineitem", "orders", "part", "embeddings")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """14 customers and 24 parts, none with an id that 50 divides, and 36 embeddings."""
    rng = np.random.default_rng(40)
    at, n_orders, n_lines = str(tmp_path_factory.mktemp("tables")), 60, 200
    day = [dt.datetime(2024, 1, 1) + dt.timedelta(days=int(i)) for i in rng.permutation(n_lines)]
    words = np.array(["red", "blue", "steel", "pump", "valve", "bolt"])
    made = {
        "lineitem": {
            "l_orderkey": rng.integers(0, n_orders, n_lines), "l_partkey": rng.permutation(np.arange(n_lines) % 24) + 1,
            "l_linenumber": pa.array(np.arange(n_lines), pa.int32()), "l_returnflag": rng.choice(["N", "A", "R"], n_lines),
            "l_linestatus": ["O"] * n_lines, "l_shipdate": pa.array(day, pa.timestamp("us")),
        },
        "orders": {"o_orderkey": np.arange(n_orders), "o_custkey": np.arange(n_orders) % 14 + 1},
        "part": {
            "p_partkey": np.arange(24) + 1, "p_name": [" ".join(rng.choice(words, 2)) for _ in range(24)],
            "p_brand": [f"Brand{i}" for i in rng.integers(0, 4, 24)], "p_type": rng.choice(["SMALL", "LARGE"], 24),
            "p_size": pa.array(rng.integers(1, 5, 24), pa.int32()),
        },
        "embeddings": {
            "vec_id": np.arange(36), "embedding": pa.array(list(rng.standard_normal((36, 64)).astype(np.float32)), pa.list_(pa.float32())),
            "label": pa.array([0] * 36, pa.int32()),
        },
    }
    for name, columns in made.items():
        pq.write_table(pa.table(columns), f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", [
    "recommend_fixed_factors",
    "similar_fixed_factors",
    "knn_approx_recall",
    "knn_tfidf",
    "recommend_content",
    "similar_items_content",
    "recommend_hybrid_fixed",
    "similar_items_hybrid_fixed",
])
def test_every_id_is_answered_as_in_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    mine = contract.queries()[name](spark, folder)
    columns = sorted(mine.columns)
    found = mine.select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(db.execute(contract.oracle_sql()[name]).df()[columns].itertuples(index=False, name=None))
    if name == "knn_approx_recall":
        assert found[0].n_items == 36 and found[0].n_neighbors == 360
    elif name.startswith("recommend"):
        assert {r.user_id for r in found} == set(range(1, 15))
    else:
        assert {r.item_id for r in found} == set(range(1, 25))


@pytest.mark.parametrize("name", ["recommend_cf", "similar_items_cf", "similar_items_hybrid", "recommend_hybrid"])
def test_every_id_is_answered_by_trained_factors(spark, folder, name):
    found = contract.queries()[name](spark, folder).collect()
    if name.startswith("recommend"):
        assert {r.user_id for r in found} <= set(range(1, 15)) and len({r.user_id for r in found}) >= 13
    else:
        assert {r.item_id for r in found} == set(range(1, 25))
