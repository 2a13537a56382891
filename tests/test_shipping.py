"""The package on the driver's path alone: shipped, tasks find it."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from raretide.operators.regress import Spec, fit_models
from raretide.session import ship, work_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ship(spark)
df = spark.range(40).select((F.col("id") % 5).alias("y"))
print("CONVERGED", fit_models(df, "y", [Spec("poisson")])[0].converged, bool(work_dir(spark)))
"""


def test_tasks_find_a_shipped_package(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "CONVERGED True True" in done.stdout, done.stderr[-2000:]
