"""Results that must not depend on the machine, from a folder without this repository and without PYTHONPATH."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from tidepool.session import build_session
spark = build_session("cores", "local[{cores}]", spark__sql__shuffle__partitions=4, spark__driver__memory="3g")
spark.sparkContext.setLogLevel("OFF")
print("ROWS", sorted(map(tuple, contract.recommend_cf(spark, contract.SMOKE_DIR).select("user_id", "item_id", "rank").collect())))
"""


def test_factor_lists_are_the_same_with_2_4_and_8_cores(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = set()
    for cores in (2, 4, 8):
        run = subprocess.run(
            [sys.executable, "-c", RUN.format(repo=REPO, cores=cores)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
        )
        found.add(run.stdout.partition("ROWS")[2] or run.stderr[-2000:])
    assert len(found) == 1 and found.pop().startswith(" [(")
