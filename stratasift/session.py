"""Session builder with the settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app_name: str = "stratasift", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session; local where no master is given by spark-submit, the environment or a default file."""
    from pyspark import SparkConf

    given = SparkConf()
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = SparkSession.builder.appName(app_name)
    local = given.get("spark.master") is None and not os.environ.get("MASTER") and not os.environ.get("SPARK_REMOTE")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if local:
        builder = builder.master(f"local[{cores}]")
        settings |= {"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(shuffle_partitions or cores)}
    elif shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        if given.get(key) is None:
            builder = builder.config(key, value)
    return builder.getOrCreate()
