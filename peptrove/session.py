"""Spark sessions with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "peptrove", **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``options`` are Spark settings, dots as underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in options.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
