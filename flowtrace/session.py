"""Spark session with the settings that every query here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster, master and partitions come from spark-submit."""
    b = SparkSession.builder.appName("flowtrace").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
