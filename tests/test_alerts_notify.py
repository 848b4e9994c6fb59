import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import scores
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import notify, requests
from tidewatch.functions.text import address_list

T0 = datetime(2026, 1, 14, 1)


def act(spark, *kinds):
    """One alert's actions as ``(kind, actor)``, an hour apart."""
    return spark.createDataFrame(
        [(1, kind, actor, T0 + timedelta(hours=i), i) for i, (kind, actor) in enumerate(kinds)], S.ALERT_ACTIONS
    )


@pytest.mark.parametrize("kinds, want", [
    ([("ACK", "b"), ("RESOLVED", "a")], ("RESOLVED", "b", 0, "a", 1)),
    ([("RESOLVED", "a"), ("ACK", "b")], ("ACK", "b", 0, "a", 0)),
    ([("ACK", "b"), ("ACK", "c")], ("ACK", "c", 0, None, None)),
    ([("RESOLVED", "a"), ("RESOLVED", "d")], ("RESOLVED", "a", 0, "d", 0)),
    ([], ("OPEN", None, None, None, None)),
])
def test_lifecycle(spark, alert_rows, one, kinds, want):
    got = one(alert_ops.apply_actions(alert_rows({}), act(spark, *kinds)))
    hours = [None if want[i] is None else T0 + timedelta(hours=want[i]) for i in (2, 4)]
    assert (got["status"], got["acked_by"], got["acked_at"], got["resolved_by"], got["resolved_at"]) == (
        want[0], want[1], hours[0], want[3], hours[1],
    )


def test_unknown_alerts_are_reported(spark, alert_rows):
    assert alert_ops.unknown_actions(act(spark, ("ACK", "a")), alert_rows({"alert_id": 9})).count() == 1


def outcome(spark, *given):
    return spark.createDataFrame(
        [(a, "webhook", t, s, "{}", e) for a, t, s, e in given],
        "alert_id long, channel string, target string, status string, payload string, error string",
    )


def test_failed_deliveries_stay_due_oldest_first(spark, alert_rows, rows):
    alerts = alert_rows(*[{"alert_id": i, "ts": T0 + timedelta(minutes=10 - i)} for i in range(1, 6)])
    stored = notify.outcome_rows(
        outcome(spark, (5, "x", "sent", None), (4, "x", "failed", "boom"), (3, "y", "sent", None)), T0
    )
    targets = address_list(F.lit("x,y"))
    due = rows(notify.pending(alerts, stored, "webhook", targets, limit=3), "target", "position")
    assert [(r["target"], r["alert_id"]) for r in due] == [("x", 4), ("x", 3), ("x", 2), ("y", 5), ("y", 4), ("y", 2)]
    # Another channel has its own record.
    assert notify.pending(alerts, stored, "email", targets).count() == 10


def test_email_queue(alert_rows, spark, one):
    alerts = alert_rows({"metric_date": None, "risk_score": 8.6, "context": {"impact": 4.0}})
    empty = spark.createDataFrame([], S.ALERT_NOTIFICATIONS)
    mail = one(notify.email_queue(alerts, empty, " a@x , b@x,", subject_prefix="[RISK]"))
    assert mail["target"] == "a@x,b@x" and mail["subject"] == "[RISK] WARN tx_fail_rate"
    assert mail["body"] == (
        "Alert details:\nMetric: tx_fail_rate\nSeverity: WARN\nRisk score: 8.6\nMessage: off its week\n"
        'Timestamp: 2026-01-14 01:01:00\nContext: {"method":"z_score","impact":4.0}\n'
    )
    payload = json.loads(mail["payload"])
    assert payload == {"subject": mail["subject"], "recipients": ["a@x", "b@x"], "alert_id": 1}
    for nobody in (None, "", " , "):
        assert notify.email_queue(alerts, empty, nobody).count() == 0
        assert notify.webhook_queue(alerts, empty, nobody).count() == 0


def test_webhook_payload(alert_rows, spark, one):
    empty = spark.createDataFrame([], S.ALERT_NOTIFICATIONS)
    call = one(notify.webhook_queue(alert_rows({"context": {"impact": 4.0}}), empty, "https://h/1"))
    payload = json.loads(call["payload"])
    assert set(payload) == {
        "alert_id", "metric_name", "metric_date", "severity", "risk_score", "message", "context", "timestamp",
    }
    assert payload["metric_date"] == "2026-01-13" and payload["context"]["impact"] == 4.0


def test_outcome_upsert(spark, one):
    first = notify.outcome_rows(outcome(spark, (1, "x", "failed", "boom")), T0)
    later = notify.record_outcomes(first, outcome(spark, (1, "x", "sent", None)), T0 + timedelta(hours=1))
    got = one(later)
    assert (got["status"], got["last_error"], got["sent_at"]) == ("sent", None, T0 + timedelta(hours=1))
    assert got["created_at"] == T0
    back = one(notify.record_outcomes(later, outcome(spark, (1, "x", "failed", "again")), T0 + timedelta(hours=2)))
    assert back["sent_at"] is None and back["last_error"] == "again" and back["created_at"] == T0


def test_impact_by_metric(spark, rows):
    df = spark.createDataFrame(
        [("tx_fail_rate", 0.3, 0.1), ("tx_fail_rate", 0.1, 0.3), ("latency_p95_ms", 300.0, 100.0),
         ("tx_completed", 50.0, 100.0), ("dau", 50.0, 100.0), ("dau", 0.0, 0.5), ("dau", 200.0, 100.0)],
        "m string, o double, b double",
    )
    got = [r["i"] for r in rows(df.select(scores.impact(F.col("m"), F.col("o"), F.col("b")).alias("i")))]
    assert got == pytest.approx([20.0, 0.0, 2.0, 5.0, 2.5, 2.5, 0.0])


def test_severity_bands(spark, rows):
    df = spark.createDataFrame([(z,) for z in (-4.0, 3.99, 3.0, -2.5, 0.0)], "z double")
    assert [r["s"] for r in rows(df.select(scores.severity(F.col("z")).alias("s")))] == [
        "CRITICAL", "WARN", "WARN", "INFO", "INFO",
    ]


def test_request_rollups(spark, one, rows):
    log = spark.createDataFrame(
        [("GET", "/a", 200, 4.0), ("GET", "/a", 500, 20.0), ("POST", "/b", 422, 99999.0)], S.REQUEST_LOG
    )
    assert one(requests.request_totals(log)) == {"total_requests": 3, "total_errors": 1, "avg_latency_ms": 33341.0}
    assert one(requests.request_totals(log.limit(0))) == {"total_requests": 0, "total_errors": 0, "avg_latency_ms": 0.0}
    buckets = {(r["path"], r["le"]): r["n"] for r in rows(requests.latency_histogram(log))}
    assert buckets[("/a", "0.005")] == 1 and buckets[("/a", "0.025")] == 2
    assert buckets[("/b", "10.0")] == 0 and buckets[("/b", "inf")] == 1
    assert {r["metric"]: r["value"] for r in rows(requests.telemetry_table(log))}["total_errors"] == 1.0
    assert requests.request_counts(log).count() == 3


def test_alert_day_falls_back_to_the_time_raised(alert_rows, one):
    df = alert_rows({"metric_date": None})
    assert one(df.select(alert_ops.alert_day().alias("d")))["d"] == date(2026, 1, 14)
