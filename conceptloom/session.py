"""Sessions with the settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "conceptloom", **conf: str) -> SparkSession:
    """UTC dates, adaptive plans with skewed joins split; master and sizes come from the cluster or ``conf``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
