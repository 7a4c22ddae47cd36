"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_released: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; it goes when the application ends.

    Without that setting only a local master works, in a temporary folder.
    """
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        own = f"{root.rstrip('/')}/colloquy-tables-{spark.sparkContext.applicationId}"
        if own not in _released:
            _released.add(own)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    else:
        if _local is None:
            _local = tempfile.mkdtemp(prefix="colloquy-tables-")
            atexit.register(shutil.rmtree, _local, True)
        own = f"file://{_local}"
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: what is behind it, such as a model's calls, runs once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """A path of :func:`new_path` that is no longer needed goes before the application ends."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
