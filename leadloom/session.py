"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Everything that depends on the size of the cluster is left to the deployer;
# these are the settings the operators rely on for right results or good plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def local_session(cores: str | int = "*", app: str = "leadloom", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    partitions = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", os.environ.get("LEADLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # small test tables still get one task per core after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
