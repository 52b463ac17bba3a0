"""Reading tables by name from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``folder/name.parquet`` (one file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system its scheme names, else the session's default one."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def optional_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Like :func:`table`, but an empty relation of ``schema`` where the table is absent."""
    if exists(spark, f"{folder}/{name}.parquet"):
        return table(spark, folder, name)
    return spark.createDataFrame([], schema)


def prefixed(spark: SparkSession, folder: str, prefix: str, schema: T.StructType | None = None) -> DataFrame:
    """The Parquet files of a folder whose names start with ``prefix``."""
    reader = spark.read.option("pathGlobFilter", f"{prefix}*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(folder)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a directory of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
