"""A session with settings that suit these operators; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veritome.shipping import BATCH_BYTES, reach_workers

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "veritome", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return reach_workers((builder.master(master) if master else builder).getOrCreate())
