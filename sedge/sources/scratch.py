"""The folder for what is written between two jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, spark.checkpoint.dir. Only with a local master may
    that be unset, as in tests; a folder of this machine then takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_sedge_scratch", None)
        if not root:
            root = spark._sedge_scratch = tempfile.mkdtemp(prefix="sedge-")
    return f"{root.rstrip('/')}/sedge-{spark.sparkContext.applicationId}"


def _paths(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_sedge_paths"):
        spark._sedge_paths = []
    return spark._sedge_paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here and lost executors cost nothing
    that was computed before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def scratch_mark(spark: SparkSession) -> int:
    """A place in the row of what this application wrote, for clear_since()."""
    return len(_paths(spark))


def clear_since(spark: SparkSession, mark: int, keep_last: bool = True) -> None:
    """Delete what was written since that mark, but for the last. Only for a step whose other tables nothing reads any more."""
    paths = _paths(spark)
    old = paths[mark : len(paths) - keep_last]
    for path in old:
        _delete(spark, path)
    del paths[mark : mark + len(old)]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. DataFrames that still read it end with it."""
    _delete(spark, scratch_root(spark))
    _paths(spark).clear()
