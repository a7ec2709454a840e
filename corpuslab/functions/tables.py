"""Tables in the folder that all executors share, which cut the lineage of repeated steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder under the warehouse of a session that runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table: computed once, and readable whichever executor is lost; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for_session(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def for_session(spark: SparkSession, path: str) -> None:
    """What is at `path` goes when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
