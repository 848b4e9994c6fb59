"""Daily KPIs from raw events, all days in one go."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.functions.scores import rate
from tidewatch.operators.calendar import check_range, days_between, within
from tidewatch.operators.percentiles import daily_percentiles


def active_users(events: DataFrame) -> DataFrame:
    """Distinct non-null users per day, whatever the event type."""
    return events.groupBy("event_date").agg(F.count_distinct("user_id").cast("double").alias("dau"))


def completed_transactions(events: DataFrame) -> DataFrame:
    """Number and summed value of completed transactions per day."""
    done = F.col("event_type") == "transaction_completed"
    return events.groupBy("event_date").agg(
        F.count_if(done).cast("double").alias("tx_completed_count"),
        F.coalesce(F.sum(F.when(done, F.col("value"))), F.lit(0.0)).alias("tx_completed_value"),
    )


def failure_rate(events: DataFrame) -> DataFrame:
    """Failed over failed plus completed transactions per day; 0 without either."""
    kind = F.col("event_type")
    counted = events.groupBy("event_date").agg(
        F.count_if(kind == "transaction_failed").alias("_failed"),
        F.count_if(kind.isin("transaction_failed", "transaction_completed")).alias("_all"),
    )
    return counted.select("event_date", rate(F.col("_failed"), F.col("_all")).alias("tx_fail_rate"))


def latency_p95(events: DataFrame) -> DataFrame:
    """95th percentile of system latency per day; days without samples are absent."""
    samples = events.where(F.col("event_type") == "system_latency")
    return daily_percentiles(samples, "event_date", F.col("value"), {"latency_p95_ms": 0.95})


def daily_kpis(
    events: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Wide table: one row per day, one column per KPI.

    With both ends of a range every calendar day of it gets a row, empty days
    with zeros; otherwise the days that have events.
    """
    rows = events.where(within(F.col("event_date"), start, end))
    kind = F.col("event_type")
    done = kind == "transaction_completed"
    wide = (
        rows.groupBy("event_date")
        .agg(
            F.count_distinct("user_id").cast("double").alias("dau"),
            F.count_if(done).cast("double").alias("tx_completed_count"),
            F.coalesce(F.sum(F.when(done, F.col("value"))), F.lit(0.0)).alias("tx_completed_value"),
            F.count_if(kind == "transaction_failed").alias("_failed"),
        )
        .withColumn(
            "tx_fail_rate", rate(F.col("_failed"), F.col("_failed") + F.col("tx_completed_count"))
        )
        .drop("_failed")
    )
    # Two tables of one row per calendar day.
    wide = wide.join(F.broadcast(latency_p95(rows)), "event_date", "left")
    if start is None or end is None:
        return wide
    spine = days_between(events.sparkSession, start, end, "event_date")
    return spine.join(wide, "event_date", "left").fillna(
        0.0, ["dau", "tx_completed_count", "tx_completed_value", "tx_fail_rate"]
    )


def kpi_rows(wide: DataFrame) -> DataFrame:
    """Long form ``(metric_date, metric_name, value, dimensions)``; absent KPIs have no row."""
    return (
        wide.unpivot("event_date", list(S.KPI_NAMES), "metric_name", "value")
        .where(F.col("value").isNotNull())
        .select(
            F.col("event_date").alias("metric_date"),
            "metric_name",
            "value",
            F.lit("{}").alias("dimensions"),
        )
    )


def backfill(events: DataFrame, start: date, end: date) -> DataFrame:
    """KPI rows of every day of a closed range."""
    check_range(start, end)
    return kpi_rows(daily_kpis(events, start, end))
