"""Executive overview: health, stability, confidence, exposure and top risks.

``daily_overview`` judges every day by that day's alerts and the report in
force; ``recent_overview`` judges one day by the newest alerts and the newest
report, whatever their dates.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import schemas as S
from tidewatch.functions import scores
from tidewatch.operators.alerts import alert_day
from tidewatch.operators.calendar import fan_out
from tidewatch.operators.placeholder import or_placeholder
from tidewatch.plans.reads import newest_alerts

_STABILITY_REACH = 6
TOP_RISKS = 5
RISK_FIELDS = ["metric_name", "severity", "risk_score", "message"]


def _impact() -> Column:
    return F.coalesce(F.col("context")["impact"], F.lit(0.0))


def _variation() -> Column:
    """Coefficient of variation of the grouped values; null where undefined."""
    mean = F.avg("value")
    return F.when((F.count("value") >= 2) & (mean != 0), F.stddev_samp("value") / F.abs(mean))


def stability_by_day(
    metrics: DataFrame, days: DataFrame, names: tuple[str, ...] = S.BOARD_METRICS
) -> DataFrame:
    """Stability index of each of ``days`` from the seven days ending on it."""
    spread = metrics.where(F.col("metric_name").isin(*names)).select(
        "metric_name", "value", fan_out("metric_date", "day", 0, _STABILITY_REACH)
    )
    by_metric = spread.groupBy("day", "metric_name").agg(_variation().alias("cv"))
    by_day = by_metric.groupBy("day").agg(F.sum("cv").alias("cv"))
    return days.join(by_day, "day", "left").select(
        "day", scores.stability(F.col("cv")).alias("stability_index")
    )


def report_in_force(reports: DataFrame, days: DataFrame) -> DataFrame:
    """For each of ``days`` the verdict of the latest report up to it.

    Runs over one row per calendar day, hence the single ordered window.
    """
    known = reports.select(
        F.col("report_date").alias("day"),
        F.struct(
            "report_date", F.col("pass").alias("passes"), F.col("summary")["confidence"].alias("confidence")
        ).alias("_r"),
    )
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timeline = days.join(known, "day", "full").withColumn(
        "_r", F.last("_r", ignorenulls=True).over(so_far)
    )
    return days.join(timeline, "day").select(
        "day",
        F.col("_r")["report_date"].alias("report_date"),
        F.col("_r")["passes"].alias("passes"),
        F.col("_r")["confidence"].alias("confidence"),
    )


def alerts_by_day(alerts: DataFrame) -> DataFrame:
    """Open alerts and financial exposure per alert day."""
    return alerts.groupBy(alert_day().alias("day")).agg(
        F.count_if(F.col("status") == "OPEN").alias("open_alerts"),
        F.sum(_impact()).alias("financial_exposure"),
    )


def status_by_day(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(alert_day().alias("day"), "status").agg(F.count(F.lit(1)).alias("n"))


def daily_overview(
    days: DataFrame, reports: DataFrame, alerts: DataFrame, metrics: DataFrame
) -> DataFrame:
    """One row per day of ``days`` (column ``day``)."""
    # One row per calendar day on every side.
    joined = (
        report_in_force(reports, days)
        .join(F.broadcast(alerts_by_day(alerts)), "day", "left")
        .join(F.broadcast(stability_by_day(metrics, days)), "day", "left")
    )
    open_alerts = F.coalesce("open_alerts", F.lit(0))
    return joined.select(
        "day",
        scores.health_score(open_alerts, F.col("passes")).alias("health_score"),
        "stability_index",
        (F.coalesce("confidence", F.lit(0.0)) * 100.0).alias("dq_confidence"),
        F.coalesce("financial_exposure", F.lit(0.0)).alias("financial_exposure"),
    )


def top_risks_by_day(alerts: DataFrame, limit: int = TOP_RISKS) -> DataFrame:
    """Highest risk scores of each alert day, ranked; equal scores by id."""
    order = Window.partitionBy("day").orderBy(F.desc("risk_score"), "alert_id")
    return (
        alerts.withColumn("day", alert_day())
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select("day", "position", *RISK_FIELDS)
    )


def top_risks_recent(alerts: DataFrame, limit: int = TOP_RISKS) -> DataFrame:
    """The newest alerts, by time rather than by score."""
    return newest_alerts(alerts, limit).select(*RISK_FIELDS, "context")


def recent_overview(
    day: date, reports: DataFrame, alerts: DataFrame, metrics: DataFrame
) -> DataFrame:
    """One row for ``day`` from the newest 50 alerts and the newest report."""
    report = reports.agg(
        F.max_by(
            F.struct(F.col("pass").alias("passes"), F.col("summary")["confidence"].alias("confidence")),
            "report_date",
        )
    )
    newest = newest_alerts(alerts, S.DEFAULT_LIST_LIMIT).agg(
        F.struct(
            F.count_if(F.col("status") == "OPEN").alias("open_alerts"),
            F.coalesce(F.sum(_impact()), F.lit(0.0)).alias("exposure"),
        )
    )
    week = F.col("metric_date").between(
        F.lit(day - timedelta(days=_STABILITY_REACH)), F.lit(day)
    )
    variation = (
        metrics.where(F.col("metric_name").isin(*S.BOARD_METRICS) & week)
        .groupBy("metric_name")
        .agg(_variation().alias("cv"))
        .agg(F.sum("cv"))
    )
    parts = metrics.sparkSession.range(1).select(
        report.scalar().alias("r"), newest.scalar().alias("a"), variation.scalar().alias("cv")
    )
    return parts.select(
        F.lit(day).alias("day"),
        scores.health_score(F.col("a")["open_alerts"], F.col("r")["passes"]).alias("health_score"),
        scores.stability(F.col("cv")).alias("stability_index"),
        (F.coalesce(F.col("r")["confidence"], F.lit(0.0)) * 100.0).alias("dq_confidence"),
        F.col("a")["exposure"].alias("financial_exposure"),
    )


def risk_table(top_risks: DataFrame) -> DataFrame:
    """Top risks under display names; a stand-in row when there are none."""
    shown = top_risks.select(
        F.col("metric_name").alias("Risk"),
        F.col("severity").alias("Severity"),
        F.round("risk_score", 2).alias("Score"),
        F.col("message").alias("Summary"),
    )
    return or_placeholder(
        shown,
        Risk="No material risks",
        Severity="INFO",
        Score=0.0,
        Summary="Operating within expected thresholds.",
    )
