"""Plain lookups over the stored tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.operators.placeholder import or_placeholder

NO_REPORT_DATE = "1970-01-01"
NO_REPORT_SUMMARY = '{"note":"no reports yet"}'


def check_limit(limit: int) -> int:
    if not 1 <= limit <= S.MAX_LIST_LIMIT:
        raise ValueError(f"limit must lie between 1 and {S.MAX_LIST_LIMIT}, got {limit}")
    return limit


def _as_text(*names: str) -> dict[str, Column]:
    return {name: F.col(name).cast("string") for name in names}


def metric_series(metrics: DataFrame, metric: str, start: date, end: date) -> DataFrame:
    """Points of one metric over a closed date range, oldest first."""
    wanted = (F.col("metric_name") == metric) & F.col("metric_date").between(F.lit(start), F.lit(end))
    return (
        metrics.where(wanted)
        .orderBy("metric_date")
        .select(F.col("metric_date").cast("string").alias("metric_date"), "metric_name", "value", "dimensions")
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report as text and JSON; a stand-in when there is none."""
    newest = reports.agg(
        F.max("report_date").alias("d"),
        F.max_by(F.struct("pass", "summary"), "report_date").alias("r"),
    ).where(F.col("d").isNotNull())
    shown = newest.select(
        F.col("d").cast("string").alias("report_date"),
        F.col("r")["pass"].alias("pass"),
        F.to_json(F.col("r")["summary"]).alias("summary"),
    )
    return or_placeholder(
        shown, report_date=NO_REPORT_DATE, **{"pass": False}, summary=NO_REPORT_SUMMARY
    )


def newest_alerts(alerts: DataFrame, limit: int) -> DataFrame:
    """Alert rows, newest first; equal times by id."""
    return alerts.orderBy(F.desc("ts"), "alert_id").limit(check_limit(limit))


def recent_alerts(alerts: DataFrame, limit: int = S.DEFAULT_LIST_LIMIT) -> DataFrame:
    """The newest alerts with times and dates as text."""
    return newest_alerts(alerts, limit).withColumns(
        _as_text("ts", "metric_date", "acked_at", "resolved_at")
    )


def recent_notifications(
    notifications: DataFrame, alerts: DataFrame, limit: int = S.DEFAULT_LIST_LIMIT
) -> DataFrame:
    """The newest notifications with their alert's metric and severity."""
    newest = notifications.orderBy(F.desc("created_at"), "notification_id").limit(check_limit(limit))
    about = alerts.select("alert_id", "metric_name", "severity")
    return (
        newest.join(about, "alert_id", "left")
        .select(
            "notification_id", "alert_id", "channel", "target", "status",
            F.col("sent_at").cast("string").alias("sent_at"),
            F.col("created_at").cast("string").alias("created_at"),
            "last_error", "metric_name", "severity",
        )
        .orderBy(F.desc("created_at"), "notification_id")
    )
