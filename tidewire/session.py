"""The session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewire", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; AQE coalesces small and splits skewed shuffle partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (wanted | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
