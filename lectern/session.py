"""Session construction for local runs; on a cluster pass the session that spark-submit made."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "lectern", **extra: str) -> SparkSession:
    """A local session with the settings the engine is tuned for (AQE, UTC, Arrow, small shuffles)."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
