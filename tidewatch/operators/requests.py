"""Request telemetry rolled up from a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.functions.scores import rate

_ERROR_FROM = 500


def request_totals(log: DataFrame) -> DataFrame:
    """One row: requests, server errors and mean latency (two decimals)."""
    summed = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("status") >= _ERROR_FROM).alias("total_errors"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("_latency"),
    )
    mean = F.round(rate(F.col("_latency"), F.col("total_requests")), 2)
    return summed.select("total_requests", "total_errors", mean.alias("avg_latency_ms"))


def request_counts(log: DataFrame) -> DataFrame:
    """Requests by method, path and status."""
    return log.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative latency buckets per path: requests at or below each bound."""
    seconds = F.col("latency_ms") / 1000.0
    bounds = [*S.LATENCY_BUCKETS_SEC, float("inf")]
    counted = log.groupBy("path").agg(
        *[F.count_if(seconds <= bound).alias(str(bound)) for bound in bounds]
    )
    return counted.unpivot("path", [f"`{bound}`" for bound in bounds], "le", "n")


def telemetry_table(log: DataFrame) -> DataFrame:
    """The totals as ``(metric, value)`` rows."""
    names = ["total_requests", "total_errors", "avg_latency_ms"]
    wide = request_totals(log).select(*[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([], names, "metric", "value")
