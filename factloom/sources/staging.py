"""Results written to the folder that all executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; where none is set, one of our own on a local master and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (root or "file:///tmp/checkpoints/factloom").rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which drop_staged() deletes."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a result into the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, name: str) -> bool:
    """Deletes a staged table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def drop_staged(spark: SparkSession) -> int:
    """Deletes what this process has staged so far and gives the number of tables; results that still read them are lost."""
    dropped = 0
    while _written:
        dropped += drop_path(spark, _written.pop())
    return dropped
