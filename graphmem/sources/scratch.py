"""Tables that cut the lineage of iterations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in a folder of this machine only where that is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    folder = folder or "/tmp/checkpoints/graphmem"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame of ``written``, once nothing reads it any more."""
    if path := getattr(df, "_written_path", None):
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
