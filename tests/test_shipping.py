"""Python tasks must run on executors that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from tideline.session import local_session
spark = local_session(cores=4, shuffle_partitions=2)
queries = entry.queries()
for name in ("call_budget", "tree_drivers", "call_budget_stream", "session_profile_stream"):
    assert not queries[name](spark, "/root/testdata/sf0.001").isEmpty(), name
print("all ran")
"""


def test_python_tasks_need_no_package_on_the_executors(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=240
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]


CLUSTER = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tideline.operators.boosting import grow_models
spark = (
    SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
)
rows = spark.range(400).select(
    F.array(F.col("id") % 7, F.col("id") % 11).cast("array<double>").alias("x"),
    (F.col("id") % 7 > 3).cast("int").alias("label"), F.lit(1.0).alias("weight"),
)
settings = [{{"n_estimators": 2, "num_leaves": 4}}, {{"n_estimators": 1, "num_leaves": 3}}]
edges, grown = grow_models(rows, settings)
assert [[len(t.value) > 1 for t in trees] for _, trees in grown] == [[True, True], [True]]
print("all grown")
"""


def test_trees_are_finished_on_executors_without_the_package(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", CLUSTER, str(tmp_path / "shared")], cwd=tmp_path, capture_output=True, text=True, timeout=240
    )
    assert "all grown" in done.stdout, done.stderr[-2000:]
