"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def ready_checkpoints(df: DataFrame) -> None:
    """checkpoint() needs a folder: the session's own, or on a local master a temporary one where none is set."""
    spark = df.sparkSession
    where = _shared(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{_shared(spark).rstrip('/')}/seqweft-{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """The table, written once and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a stored table that nothing needs any more."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("seqweft-"):
            raise ValueError(f"{folder} is no stored table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
