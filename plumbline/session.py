"""Session settings the library expects. Nothing here replaces a setting the cluster has made."""
from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; `conf` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
