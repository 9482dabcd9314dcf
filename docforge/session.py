"""Session defaults. On a cluster the submit command's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, more: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("docforge")
    if master:
        builder = builder.master(master)
    spark = builder.config(map=DEFAULTS | (more or {})).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
