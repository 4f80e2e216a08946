import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract

WITHOUT_SQL = {
    "als_factors", "als_training_loss", "recommend_cf", "similar_items_cf", "svd_item_vectors", "knn_approx",
    "recommend_hybrid", "similar_items_hybrid", "evaluate_hybrid",
}


def test_every_query_has_sql_unless_it_is_learned():
    own = {n for n in contract.queries() if n != "pipeline" and not n.startswith("op")}
    assert len(own) == 61 and set(contract.oracle_sql()) & own == own - WITHOUT_SQL


def test_own_queries_need_no_optional_module():
    """Where a module of the optional part is missing, the queries of the rest are there and the reason is told."""
    code = (
        "import sys; sys.modules['duckdb'] = None\n"
        f"sys.path.insert(0, {os.path.dirname(os.path.abspath(contract.__file__))!r})\n"
        "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"
    )
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    own = [n for n in contract.queries() if n != "pipeline" and not n.startswith("op")]
    assert run.stdout.split()[:1] == [str(len(own))] and "left out" in run.stderr, run.stderr


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["user_id", "item_id", "score", "rank"] and result.count() > 0


@pytest.mark.parametrize("name", ["interaction_matrix", "transition_probs", "category_performance_report", "knn_cosine", "recommend_content", "scan_events", "recommend_hybrid_fixed"])
def test_spark_equals_sql(spark, name):
    import duckdb

    folder = contract.SMOKE_DIR
    db = duckdb.connect()
    for table in ("lineitem", "orders", "part", "events", "embeddings", "supplier", "nation", "region"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    mine = contract.queries()[name](spark, folder)
    columns = sorted(mine.columns)
    theirs = db.execute(contract.oracle_sql()[name]).df()[columns]
    assert sorted(map(tuple, mine.select(columns).collect())) == sorted(theirs.itertuples(index=False, name=None))
