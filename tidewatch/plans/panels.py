"""Detail panel: display tables for a date window, and for the newest rows.

Window tables select by alert day; recent tables take the newest rows whatever
their day.  Column names are the panel's headings.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.functions import text
from tidewatch.operators.alerts import alert_day
from tidewatch.operators.placeholder import or_placeholder
from tidewatch.plans.reads import newest_alerts, recent_notifications

WINDOW_ROWS = 10
ANOMALY_ROWS = 5


def _in_window(start: date, end: date) -> Column:
    return alert_day().between(F.lit(start), F.lit(end))


def _or_blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- tables of both panels -------------------------------------------------

def _metrics_table(rows: DataFrame) -> DataFrame:
    shown = rows.select(F.col("metric_name").alias("Metric"), F.round("value", 4).alias("Value"))
    return or_placeholder(shown, Metric="No data", Value=0.0)


def _alerts_table(rows: DataFrame) -> DataFrame:
    shown = rows.select(
        F.col("metric_name").alias("Alert"),
        F.col("severity").alias("Severity"),
        F.round("risk_score", 2).alias("Risk"),
        F.col("status").alias("Status"),
        F.col("ts").cast("string").alias("Timestamp"),
    )
    return or_placeholder(
        shown, Alert="No recent alerts", Severity="INFO", Risk=0.0, Status="OPEN", Timestamp=""
    )


def _anomalies_table(rows: DataFrame) -> DataFrame:
    context = F.col("context")
    shown = rows.select(
        F.col("metric_name").alias("Metric"),
        F.round(F.coalesce(context["impact"], F.lit(0.0)), 2).alias("Impact"),
        F.coalesce(context["method"], F.lit("n/a")).alias("Method"),
        F.col("ts").cast("string").alias("Timestamp"),
    )
    return or_placeholder(shown, Metric="No anomalies", Impact=0.0, Method="n/a", Timestamp="")


def notifications_table(
    notifications: DataFrame, alerts: DataFrame, limit: int = WINDOW_ROWS
) -> DataFrame:
    """The newest notifications; the window panel shows 10, the recent one 50."""
    shown = recent_notifications(notifications, alerts, limit).select(
        F.col("channel").alias("Channel"),
        F.col("target").alias("Target"),
        F.col("status").alias("Status"),
        _or_blank("metric_name").alias("Alert"),
        _or_blank("severity").alias("Severity"),
        F.coalesce("sent_at", "created_at", F.lit("")).alias("Sent At"),
    )
    return or_placeholder(
        shown,
        Channel="-", Target="-", Status="n/a", Alert="No notifications",
        **{"Severity": "", "Sent At": ""},
    )


# --- window panel ----------------------------------------------------------

def window_metrics(metrics: DataFrame, start: date, end: date) -> DataFrame:
    """Every metric of the latest metric date inside the window."""
    inside = metrics.where(F.col("metric_date").between(F.lit(start), F.lit(end)))
    latest = inside.agg(F.max("metric_date")).scalar()
    return _metrics_table(metrics.where(F.col("metric_date") == latest).orderBy("metric_name"))


def window_alerts(alerts: DataFrame, start: date, end: date) -> DataFrame:
    """The newest alerts of the window."""
    return _alerts_table(newest_alerts(alerts.where(_in_window(start, end)), WINDOW_ROWS))


def window_anomalies(alerts: DataFrame, start: date, end: date) -> DataFrame:
    """The alerts of the window with the largest impact."""
    impact = F.coalesce(F.col("context")["impact"], F.lit(0.0))
    largest = alerts.where(_in_window(start, end)).orderBy(F.desc(impact), "alert_id")
    return _anomalies_table(largest.limit(ANOMALY_ROWS))


def report_text(reports: DataFrame, until: date | None = None) -> DataFrame:
    """One row: the latest report (up to ``until``) as a line and as cards."""
    usable = reports if until is None else reports.where(F.col("report_date") <= F.lit(until))
    latest = usable.agg(
        F.max_by(
            F.struct("report_date", "pass", F.col("summary")["confidence"].alias("confidence")),
            "report_date",
        ).alias("r")
    ).select("r.*")
    line = F.when(F.col("report_date").isNull(), text.NO_REPORT_TEXT).otherwise(text.report_line())
    return latest.select(line.alias("line")).withColumn("cards", text.report_cards(F.col("line")))


# --- recent panel ----------------------------------------------------------

def recent_metrics(metrics: DataFrame, end: date) -> DataFrame:
    """The board metrics of one day."""
    rows = metrics.where(
        F.col("metric_name").isin(*S.BOARD_METRICS) & (F.col("metric_date") == F.lit(end))
    )
    last = rows.groupBy("metric_name").agg(F.max_by("value", "metric_date").alias("value"))
    return _metrics_table(last)


def recent_alerts_table(alerts: DataFrame) -> DataFrame:
    return _alerts_table(newest_alerts(alerts, S.DEFAULT_LIST_LIMIT))


def recent_anomalies(alerts: DataFrame) -> DataFrame:
    return _anomalies_table(newest_alerts(alerts, ANOMALY_ROWS))
