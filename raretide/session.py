"""Session helpers: where shared work files go, and how a table is staged there."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_unset_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a private folder serves if driver and executors are one process; on a cluster that is an error,
    because executors do not see each other's folders.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset_dirs:
        _unset_dirs[app] = tempfile.mkdtemp(prefix="raretide-")
    return _unset_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/raretide/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Iterative work (Newton passes, stepwise loops) re-reads its input many times. A parquet copy cuts
    the lineage, survives lost executors and keeps column pruning, which a cached RDD does not.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed on them.

    The functions that run inside tasks are looked up by name there. Not needed where the package is installed on
    every node or named in ``spark.submit.pyFiles``.
    """
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="raretide-")) / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
