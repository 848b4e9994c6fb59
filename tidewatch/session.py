"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC days and adaptive execution.

    Shuffle partition counts are left to the cluster (adaptive execution
    coalesces them); pass ``conf`` to override anything, with ``__`` for dots.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The jobs build plans of hundreds of columns: keep their generated code
        # and do not look up a Python call site for every column.
        "spark.sql.codegen.cache.maxEntries": "1000",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Stream state larger than executor memory stays on local disk.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
