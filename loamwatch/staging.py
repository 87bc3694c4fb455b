"""Stage tables: intermediate results that are read more than once, kept where every executor can read them.

A staged table is a Parquet folder under ``spark.checkpoint.dir``. It cuts the lineage, survives a lost
executor (unlike a local checkpoint or a cache) and is columnar, so later reads prune columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="loamwatch-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path for a stage table."""
    return f"{scratch_root(spark)}/loamwatch-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Writes ``df`` once, with the writer's ``options``, and returns the table that reads it back."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def discard(df: DataFrame) -> None:
    """Deletes the folder of a stage table that nothing reads any more."""
    spark = df.sparkSession
    if found := getattr(df, "_stage_path", None):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
