"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a folder of our own only on one machine without it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="augury-")
    return _own[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder; the files outlive any executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
