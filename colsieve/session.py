"""Session helpers shared by every module: package shipping, shared folders, conf access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers wherever they were started.

    The zipped sources go through Spark's own file server, once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "colsieve_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, what: str = "work") -> str:
    """A fresh folder URI under the session's spark.checkpoint.dir.

    A local temporary folder stands in only where the session sets none (tests, local mode).
    """
    ensure_checkpoint(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ensure_checkpoint(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; set our own checkpoint folder only if there is none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set; on a cluster it names the folder that all executors share")
    sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="checkpoints-"))


def remove_dir(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that shared_dir() named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, what: str = "stage") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder and reread it.

    Unlike an in-memory cache it survives lost executors, and later readers prune columns.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
