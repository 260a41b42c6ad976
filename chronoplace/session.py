"""Session factory (API-12)."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers hold a batch of texts at a time
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def session(master: str | None = None, name: str = "chronoplace", **more: str) -> SparkSession:
    """A session with this engine's settings; on a cluster, master comes from the submit command."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
