"""Sessions with the settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "mnemolake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings, as for the master or shuffle partitions, by ``conf``."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
