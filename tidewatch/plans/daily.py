"""The batch jobs over the stored tables, and their daily order.

Every job covers a closed range of days in one go; ``as_of`` stands for the
current time.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.operators import alerts as alert_ops, detectors, kpis, notify, quality, validation
from tidewatch.operators.calendar import check_range
from tidewatch.sources.rules import RuleConfig, load_rules, seed_if_absent, seed_rules
from tidewatch.sources.staging import is_complete, stage
from tidewatch.sources.tables import Tables


# Who retracts an alert that fires no more.
JUDGE = "system:rejudge"


def yesterday(as_of: datetime) -> date:
    return as_of.date() - timedelta(days=1)


def ingest(
    tables: Tables,
    bodies: DataFrame,
    actor: str = "system",
    whole_batches: bool = False,
    path: str = "/ingest/events",
    judged_at: str | None = None,
    origin: str | None = None,
) -> DataFrame:
    """Validate, de-duplicate and store request bodies; returns the receipts.

    ``whole_batches`` refuses a batch for one invalid event and quarantines its
    body; otherwise each invalid event is quarantined on its own.  Ids are
    checked against all stored events.  With ``judged_at``, a path of this
    delivery alone, the judgement is made once: a repeated run reads it there
    and stores what is still missing.  ``origin`` names this delivery for good:
    bodies that another one has brought before leave quarantine and audit rows
    of their own.  Without it they count as a repeat of that run.
    """
    judged_before = judged_at is not None and is_complete(tables.spark, judged_at)
    if judged_before:
        judged = tables.spark.read.parquet(judged_at)
    else:
        rows = stage(validation.explode_bodies(bodies), "parsed")
        judged = validation.classify(rows, tables.known_ids(rows), whole_batches)
        judged = stage(judged, "classified", at=judged_at)

    batches = bodies.groupBy("batch_id").agg(F.max("received_at").alias("ts"))
    answered = judged
    if whole_batches:
        answered = judged.where(F.col("reason") != validation.INVALID)
        refused = judged.where(F.col("reason") == validation.INVALID).select("batch_id").distinct()
        heard = answered.select("batch_id").distinct()
        batches = batches.join(refused.join(heard, "batch_id", "left_anti"), "batch_id", "left_anti")
        tables.append_new("events_quarantine", validation.refused_bodies(bodies, judged, path, origin))
    tables.append_new("events_quarantine", validation.refused(answered, origin))

    receipt = stage(validation.receipts(answered, batches), "receipts")
    audit = validation.audit_of_ingest(receipt.join(batches, "batch_id"), actor, F.col("ts"), origin)
    tables.append_new("audit_log", audit)
    # Last, so that a run that failed earlier can simply be repeated.  What was judged
    # just now is not stored yet: only an earlier judgement is looked up again.
    store = tables.append_new if judged_before else tables.append
    store("events_raw", validation.accepted(judged))
    return receipt


def store_kpis(tables: Tables, start: date, end: date, as_of: datetime) -> None:
    """Recompute and upsert the KPIs of a closed range."""
    rows = kpis.backfill(tables.read("events_raw"), start, end)
    tables.upsert("metrics_daily", rows.withColumn("computed_at", F.lit(as_of)))


def store_reports(tables: Tables, start: date, end: date, as_of: datetime) -> None:
    """Recompute and upsert the data-quality reports of a closed range."""
    check_range(start, end)
    card = quality.scorecard(
        tables.read("events_raw"), tables.read("events_quarantine"), as_of, start, end
    )
    tables.upsert("dq_reports", quality.reports(card, as_of))


def rules_of(tables: Tables) -> RuleConfig:
    return load_rules(seed_if_absent(tables.read("anomaly_rules"), seed_rules(tables.spark)))


def store_alerts(
    tables: Tables, start: date, end: date, as_of: datetime, dedupe: bool = True
) -> None:
    """Judge the series of a closed range and append the alerts.

    ``dedupe`` leaves out alerts already stored by an earlier run of a day.
    """
    check_range(start, end)
    reach = start - timedelta(days=S.LOOKBACK_DAYS)
    day = F.col("metric_date")
    series = tables.read("metrics_daily").where(day.between(F.lit(reach), F.lit(end)))
    found = detectors.detect(series, rules_of(tables)).where(day.between(F.lit(start), F.lit(end)))
    raised = alert_ops.to_alerts(found, F.lit(as_of).cast("timestamp"))
    if dedupe:
        stored = tables.read("alerts").where(day.between(F.lit(start), F.lit(end)))
        raised = alert_ops.unseen(raised, stored)
    tables.append("alerts", stage(raised, "alerts"))


def changed_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Series and days whose value differs between two states of the KPIs, or that only one has."""
    keys = ["metric_name", "dimensions", "metric_date"]
    both = old.select(*keys, F.col("value").alias("_old")).join(new.select(*keys, F.col("value").alias("_new")), keys, "full")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys)


def rejudge(tables: Tables, changed: DataFrame, as_of: datetime, names: tuple[str, ...] | None = S.WATCHED_METRICS) -> None:
    """Judge again the days that changed series values reach, and only those.

    ``changed`` has ``metric_name``, ``dimensions`` and ``metric_date``.  New and
    altered alerts are stored; one that fires no more is retracted, and reinstated
    if it fires again, by actions of ``JUDGE``.
    """
    reached = stage(alert_ops.reached_days(changed), "reached")
    span = reached.agg(F.min("metric_date"), F.max("metric_date")).first()
    if span[0] is None:
        return
    day = F.col("metric_date")
    history = tables.read("metrics_daily").where(
        day.between(F.lit(span[0] - timedelta(days=S.LOOKBACK_DAYS)), F.lit(span[1]))
    )
    series = history.join(reached.select("metric_name", "dimensions").distinct(), ["metric_name", "dimensions"], "left_semi")
    found = detectors.detect(series, rules_of(tables), names)
    found = found.join(reached, ["metric_name", "dimensions", "metric_date"], "left_semi")
    moment = F.lit(as_of).cast("timestamp")
    judged = stage(alert_ops.to_alerts(found, moment), "judged-alerts")
    stored = current_alerts(tables).where(day.between(F.lit(span[0]), F.lit(span[1])))
    # An alert's id names its series: the ids its reached days can have are told by metric and day.
    stored = stored.join(reached.select("metric_name", "metric_date").distinct(), ["metric_name", "metric_date"], "left_semi")
    stored = stage(stored.select(*S.ALERTS.names), "stored-alerts")
    fresh, taken = alert_ops.corrections(judged, stored)
    fresh, taken = stage(fresh, "fresh-alerts"), stage(taken, "retractions")
    if not fresh.isEmpty():
        tables.upsert("alerts", fresh)
    if not taken.isEmpty():
        tables.append("alert_actions", taken.select(
            "alert_id", "kind", F.lit(JUDGE).alias("actor"), moment.alias("action_ts"),
            F.lit(0).cast(S.ALERT_ACTIONS["seq"].dataType).alias("seq"),
        ))


def correct_kpis(tables: Tables, start: date, end: date, as_of: datetime) -> None:
    """Recompute the KPIs of a closed range, and judge again what the changes reach."""
    day = F.col("metric_date")
    before = stage(tables.read("metrics_daily").where(day.between(F.lit(start), F.lit(end))), "metrics-before")
    store_kpis(tables, start, end, as_of)
    after = tables.read("metrics_daily").where(day.between(F.lit(start), F.lit(end)))
    rejudge(tables, stage(changed_metrics(before, after), "changed-metrics"), as_of)


def current_alerts(tables: Tables) -> DataFrame:
    """Stored alerts as the action log leaves them."""
    actions = tables.read("alert_actions")
    return alert_ops.apply_retractions(alert_ops.apply_actions(tables.read("alerts"), actions), actions)


def act(tables: Tables, actions: DataFrame) -> DataFrame:
    """Append actions on known alerts with their audit; returns those on unknown ones."""
    alerts = tables.read("alerts")
    actions = stage(actions.select(*S.ALERT_ACTIONS.names), "actions")
    unknown = stage(alert_ops.unknown_actions(actions, alerts), "unknown-actions")
    tables.append("audit_log", alert_ops.audit_of_actions(actions, alerts))
    known = actions.join(alerts.select("alert_id"), "alert_id", "left_semi")
    tables.append("alert_actions", known)
    return unknown


def due_notifications(
    tables: Tables, emails: str | None = None, webhooks: str | None = None
) -> DataFrame:
    """Everything due on both channels, for a transport to deliver."""
    alerts, sent = tables.read("alerts"), tables.read("alert_notifications")
    columns = [*notify.NOTIFICATION_KEY, "position", "payload"]
    return (
        notify.email_queue(alerts, sent, emails).select(*columns)
        .unionByName(notify.webhook_queue(alerts, sent, webhooks).select(*columns))
    )


def store_outcomes(tables: Tables, outcomes: DataFrame, as_of: datetime) -> None:
    """Upsert what a transport reports back."""
    tables.upsert("alert_notifications", notify.outcome_rows(outcomes, as_of))


def run_days(
    tables: Tables,
    as_of: datetime,
    start: date | None = None,
    end: date | None = None,
    emails: str | None = None,
    webhooks: str | None = None,
) -> DataFrame:
    """Reports, KPIs, alerts, then the due notifications, for yesterday or a range.

    Give both ends of a range or neither.  A failing report does not hold back
    the KPIs or alerts.
    """
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    start, end = start or yesterday(as_of), end or yesterday(as_of)
    store_reports(tables, start, end, as_of)
    store_kpis(tables, start, end, as_of)
    store_alerts(tables, start, end, as_of)
    return due_notifications(tables, emails, webhooks)
