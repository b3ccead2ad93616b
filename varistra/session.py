"""Session settings shared by tests, bench and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "varistra", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("VARISTRA_DRIVER_MEMORY", "10g"))
        .getOrCreate()
    )
