"""A session with the settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidebook", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; Kryo and codecs stay Spark's. Other settings override these."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | settings).getOrCreate()
