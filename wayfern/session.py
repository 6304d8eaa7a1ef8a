"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC, so that wall-clock columns mean the same on every host; adaptive plans, so that skew is split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, app: str = "wayfern", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()
