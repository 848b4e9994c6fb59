"""Alerts: from detections to rows, lifecycle by action log, day and window views."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.operators.calendar import fan_out
from tidewatch.operators.keys import surrogate_id


# Status of an alert that a later judgement took back.
RETRACTED = "RETRACTED"


def to_alerts(detections: DataFrame, ts: Column) -> DataFrame:
    """Open alerts raised at ``ts``; the id repeats when a day is judged again."""
    key = surrogate_id(
        F.col("metric_name"),
        F.col("dimensions"),
        F.col("metric_date"),
        F.col("context")["method"],
        F.col("rule_version"),
    )
    nothing = F.lit(None)
    return detections.select(
        key.alias("alert_id"),
        ts.alias("ts"),
        "metric_name",
        "severity",
        "rule_version",
        "risk_score",
        "message",
        "context",
        F.lit("OPEN").alias("status"),
        nothing.cast("string").alias("acked_by"),
        nothing.cast("timestamp").alias("acked_at"),
        nothing.cast("string").alias("resolved_by"),
        nothing.cast("timestamp").alias("resolved_at"),
        "metric_date",
    )


def unseen(alerts: DataFrame, existing: DataFrame) -> DataFrame:
    """Alerts that are not stored yet, so that a rerun adds nothing.

    Id, metric, day, method and rule version must all agree.
    """
    natural = {c: F.col(c) for c in ("alert_id", "metric_name", "metric_date", "rule_version")}
    natural["method"] = F.col("context")["method"]
    keyed = alerts.withColumns({f"_{name}": value for name, value in natural.items()})
    stored = existing.select(*[value.alias(f"_stored_{name}") for name, value in natural.items()])
    same = [F.col(f"_{name}").eqNullSafe(F.col(f"_stored_{name}")) for name in natural]
    return keyed.join(stored, reduce(and_, same), "left_anti").select(alerts.columns)


def reached_days(changed: DataFrame) -> DataFrame:
    """The series and days whose frames contain a changed one: the day itself and the lookback after it.

    Positional frames decide nothing beyond the lookback, so it bounds them all.
    """
    return changed.select(
        "metric_name", "dimensions", fan_out("metric_date", "metric_date", 0, S.LOOKBACK_DAYS)
    ).distinct()


def corrections(judged: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a second judgement changes: alerts that are new or say something else, and the actions it takes.

    Alerts that fire no more are retracted, retracted ones that fire again
    reinstated.  Both arguments are alerts of the same series and days.
    """
    told = ["severity", "risk_score", "message"]
    before = stored.select("alert_id", F.struct(*told).alias("_told"))
    fresh = judged.join(before, "alert_id", "left").where(
        F.col("_told").isNull() | ~F.struct(*told).eqNullSafe(F.col("_told"))
    )
    fires = judged.select("alert_id", F.lit(True).alias("_fires"))
    standing = F.col("status") != RETRACTED
    kind = F.when(standing & F.col("_fires").isNull(), "RETRACT").when(~standing & F.col("_fires"), "REINSTATE")
    taken = stored.join(fires, "alert_id", "left").select("alert_id", kind.alias("kind")).where("kind is not null")
    return fresh.select(judged.columns), taken


def fold_actions(actions: DataFrame) -> DataFrame:
    """Per alert, the state its ACK and RESOLVED actions lead to.

    The last action sets the status; the last actor of each kind counts, the
    first time of each; resolving also acknowledges when nobody has.
    """
    order = F.struct("action_ts", "seq")
    ack = F.col("kind") == "ACK"
    resolved = F.col("kind") == "RESOLVED"
    actor, ts = F.col("actor"), F.col("action_ts")
    return (
        actions.where(F.col("kind").isin("ACK", "RESOLVED"))
        .groupBy("alert_id")
        .agg(
            F.max_by("kind", order).alias("status"),
            F.max_by(F.when(ack, actor), F.when(ack, order)).alias("_acker"),
            F.min_by(F.when(resolved, actor), F.when(resolved, order)).alias("_first_resolver"),
            F.min(ts).alias("acked_at"),
            F.max_by(F.when(resolved, actor), F.when(resolved, order)).alias("resolved_by"),
            F.min(F.when(resolved, ts)).alias("resolved_at"),
        )
        .withColumn("acked_by", F.coalesce("_acker", "_first_resolver"))
        .drop("_acker", "_first_resolver")
    )


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts as their whole action log leaves them."""
    state = fold_actions(actions)
    changed = ("status", "acked_by", "acked_at", "resolved_by", "resolved_at")
    renamed = state.select("alert_id", *[F.col(c).alias(f"_{c}") for c in changed])
    joined = alerts.join(renamed, "alert_id", "left")
    return joined.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in alerts.columns
    ])


def apply_retractions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with status ``RETRACTED`` where the last judgement took them back.

    ``RETRACT`` and ``REINSTATE`` are actions of a job, apart from what operators did.
    """
    judged = actions.where(F.col("kind").isin("RETRACT", "REINSTATE")).groupBy("alert_id").agg(
        F.max_by("kind", F.struct("action_ts", "seq")).alias("_judged")
    )
    joined = alerts.join(judged.where("_judged = 'RETRACT'"), "alert_id", "left")
    status = F.when(F.col("_judged").isNotNull(), RETRACTED).otherwise(F.col("status"))
    return joined.withColumn("status", status).select(alerts.columns)


def unknown_actions(actions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Actions on alerts that do not exist."""
    return actions.join(alerts.select("alert_id"), "alert_id", "left_anti").select(actions.columns)


def alert_day() -> Column:
    """The day an alert belongs to."""
    return F.coalesce(F.col("metric_date"), F.to_date("ts"))


def audit_of_actions(actions: DataFrame, alerts: DataFrame) -> DataFrame:
    """One audit record per action on a known alert."""
    kind = F.col("kind")
    verb = F.when(kind == "ACK", "alert_ack").otherwise("alert_resolve")
    return actions.join(alerts.select("alert_id"), "alert_id", "left_semi").select(
        surrogate_id(verb, F.col("alert_id"), F.col("action_ts"), F.col("seq")).alias("audit_id"),
        F.col("action_ts").alias("ts"),
        "actor",
        verb.alias("action"),
        F.lit("alert").alias("entity_type"),
        F.col("alert_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(kind.alias("status"))).alias("payload"),
    )
