"""Session factory: UTC, adaptive execution, sizes left to the cluster unless given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "newsgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every operator assumes.

    Keyword arguments use ``__`` in place of dots, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
