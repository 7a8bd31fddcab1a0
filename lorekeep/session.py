"""The session that the engine expects: adaptive execution, UTC, skew handling."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC")
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return (b.master(master) if master else b).getOrCreate()
