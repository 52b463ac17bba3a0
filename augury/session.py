"""Session settings for local work and tests; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "augury", cores: int | str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC; settings that a running session has stay as they are."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config(
            "spark.sql.execution.arrow.pyspark.enabled", "true"
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
