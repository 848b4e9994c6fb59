"""Notification queues: what is due, what it says, and what became of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import schemas as S
from tidewatch.functions.text import address_list, email_body, email_subject, number_text
from tidewatch.operators.keys import surrogate_id
from tidewatch.operators.merge import merge

NOTIFICATION_KEY = ["alert_id", "channel", "target"]


def _context_json() -> Column:
    """The alert context with its absent fields left out."""
    return F.to_json("context")


def pending(
    alerts: DataFrame,
    notifications: DataFrame,
    channel: str,
    targets: Column,
    limit: int = S.QUEUE_LIMIT,
) -> DataFrame:
    """Alerts not yet sent to each of ``targets``, oldest first, ``limit`` per target.

    Failed deliveries stay due and keep their place at the head of the queue.
    """
    due = alerts.withColumn("channel", F.lit(channel)).withColumn("target", F.explode(targets))
    sent = notifications.where(F.col("status") == "sent").select(*NOTIFICATION_KEY)
    oldest = Window.partitionBy("target").orderBy("ts", "alert_id")
    return (
        due.join(sent, NOTIFICATION_KEY, "left_anti")
        .withColumn("position", F.row_number().over(oldest))
        .where(F.col("position") <= limit)
    )


def email_queue(
    alerts: DataFrame,
    notifications: DataFrame,
    recipients: str | None,
    subject_prefix: str = "[ALERT]",
    limit: int = S.QUEUE_LIMIT,
) -> DataFrame:
    """Due e-mails to the whole recipient list; empty without recipients."""
    people = address_list(F.lit(recipients).cast("string"))
    joined = F.array_join(people, ",")
    targets = F.when(F.size(people) > 0, F.array(joined)).otherwise(F.array().cast("array<string>"))
    due = pending(alerts, notifications, "email", targets, limit)
    parts = {
        "metric_name": F.col("metric_name"),
        "severity": F.col("severity"),
        "risk_score": number_text(F.col("risk_score")),
        "message": F.col("message"),
        "ts": F.col("ts"),
        "context": _context_json(),
    }
    mail = due.withColumns({
        "subject": email_subject(
            subject_prefix, F.col("severity"), F.col("metric_name"), F.col("metric_date")
        ),
        "body": email_body(parts),
        "recipients": people,
    })
    payload = F.to_json(F.struct("subject", "recipients", "alert_id"))
    return mail.select(
        *NOTIFICATION_KEY, "position", "subject", "body", "recipients", payload.alias("payload")
    )


def webhook_queue(
    alerts: DataFrame,
    notifications: DataFrame,
    urls: str | None,
    limit: int = S.QUEUE_LIMIT,
) -> DataFrame:
    """Due webhook calls, one row per target and alert with its JSON payload."""
    targets = address_list(F.lit(urls).cast("string"))
    due = pending(alerts, notifications, "webhook", targets, limit)
    payload = F.to_json(
        F.struct(
            "alert_id",
            "metric_name",
            F.col("metric_date").cast("string").alias("metric_date"),
            "severity",
            "risk_score",
            "message",
            "context",
            F.col("ts").cast("string").alias("timestamp"),
        )
    )
    return due.select(*NOTIFICATION_KEY, "position", payload.alias("payload"))


def outcome_rows(outcomes: DataFrame, at: datetime | Column) -> DataFrame:
    """Delivery outcomes ``(key, status, payload, error)`` as notification rows."""
    moment = at if isinstance(at, Column) else F.lit(at)
    moment = moment.cast("timestamp")
    return outcomes.select(
        surrogate_id(*[F.col(c) for c in NOTIFICATION_KEY]).alias("notification_id"),
        *NOTIFICATION_KEY,
        "status",
        "payload",
        F.col("error").alias("last_error"),
        F.when(F.col("status") == "sent", moment).alias("sent_at"),
        moment.alias("created_at"),
    )


def record_outcomes(notifications: DataFrame, outcomes: DataFrame, at: datetime | Column) -> DataFrame:
    """Notifications with the outcomes upserted; id and creation time stay."""
    rows = outcome_rows(outcomes, at)
    return merge(notifications, rows, NOTIFICATION_KEY, keep=("notification_id", "created_at"))
