"""A session with the settings this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quern", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
