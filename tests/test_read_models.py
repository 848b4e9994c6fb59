import json
from datetime import date, datetime, timedelta

import pytest

from tidewatch import schemas as S
from tidewatch.operators import notify
from tidewatch.plans import overview, panels, reads

DAY = date(2026, 1, 13)
T0 = datetime(2026, 1, 14, 1)


@pytest.fixture
def days(spark):
    return lambda *given: spark.createDataFrame([(d,) for d in given], "day date")


@pytest.fixture
def nothing(spark):
    return lambda schema: spark.createDataFrame([], schema)


def test_day_overview(days, report_rows, alert_rows, series, one):
    alerts = alert_rows({"risk_score": 7.7, "context": {"impact": 6.5}})
    metrics = series({"tx_fail_rate": {DAY: 0.4}})
    got = one(overview.daily_overview(days(DAY), report_rows((DAY, True, 0.8)), alerts, metrics))
    assert got == {
        "day": DAY, "health_score": 92, "stability_index": 100.0, "dq_confidence": 80.0, "financial_exposure": 6.5,
    }
    assert one(overview.top_risks_by_day(alerts))["metric_name"] == "tx_fail_rate"


def test_overview_without_anything(days, nothing, one):
    got = one(overview.daily_overview(
        days(DAY), nothing(S.DQ_REPORTS), nothing(S.ALERTS), nothing(S.METRICS_DAILY)
    ))
    assert (got["health_score"], got["stability_index"], got["dq_confidence"], got["financial_exposure"]) == (85, 100.0, 0.0, 0.0)


def test_health_penalty_is_capped(days, nothing, report_rows, alert_rows, one):
    many = alert_rows(*[{} for _ in range(20)])
    got = one(overview.daily_overview(days(DAY), report_rows((DAY, False, 0.5)), many, nothing(S.METRICS_DAILY)))
    assert got["health_score"] == 25


def test_report_in_force(days, report_rows, rows):
    reports = report_rows((DAY, True, 0.5), (DAY + timedelta(days=3), False, 0.6))
    wanted = [DAY + timedelta(days=d) for d in (-1, 0, 2, 3, 9)]
    got = rows(overview.report_in_force(reports, days(*wanted)), "day")
    assert [r["passes"] for r in got] == [None, True, True, False, False]
    assert [r["confidence"] for r in got] == [None, 0.5, 0.5, 0.6, 0.6]


def test_stability(series, days, one, close):
    points = {DAY - timedelta(days=d): v for d, v in zip((2, 1, 0), (0.1, 0.2, 0.3))}
    metrics = series({"tx_fail_rate": points, "tx_completed_count": points, "dau": {DAY: 5}})
    assert close(one(overview.stability_by_day(metrics, days(DAY)))["stability_index"], 50.0)
    # A day without its own row still looks back six days.
    assert close(one(overview.stability_by_day(metrics, days(DAY + timedelta(days=4))))["stability_index"], 50.0)
    assert one(overview.stability_by_day(metrics, days(DAY + timedelta(days=7))))["stability_index"] == 100.0
    zero = series({"dau": {DAY: 1, DAY - timedelta(days=1): -1}})
    assert one(overview.stability_by_day(zero, days(DAY)))["stability_index"] == 100.0


def test_recent_overview_ignores_days(report_rows, alert_rows, series, one, rows):
    alerts = alert_rows(*[
        {"ts": T0 + timedelta(minutes=i), "metric_date": DAY - timedelta(days=i), "risk_score": float(100 - i),
         "status": "OPEN" if i % 2 else "ACK", "context": {"impact": 1.0}}
        for i in range(60)
    ])
    reports = report_rows((DAY + timedelta(days=30), True, 0.5), (DAY, False, 0.1))
    got = one(overview.recent_overview(DAY, reports, alerts, series({"dau": {DAY: 5}})))
    assert (got["health_score"], got["dq_confidence"], got["financial_exposure"]) == (40, 50.0, 50.0)
    newest = rows(overview.top_risks_recent(alerts))
    assert [r["risk_score"] for r in newest] == [41.0, 42.0, 43.0, 44.0, 45.0]


def test_lists(alert_rows, rows, nothing, spark):
    alerts = alert_rows(*[{"ts": T0 + timedelta(minutes=i)} for i in range(60)])
    assert [r["alert_id"] for r in rows(reads.recent_alerts(alerts, 2))] == [60, 59]
    assert reads.recent_alerts(alerts).count() == 50
    assert rows(reads.recent_alerts(alerts, 1))[0]["ts"] == "2026-01-14 01:59:00"
    for limit in (0, 201):
        with pytest.raises(ValueError):
            reads.recent_alerts(alerts, limit)
    outcomes = spark.createDataFrame(
        [(1, "email", "a", "sent", "{}", None), (777, "email", "a", "failed", "{}", "x")],
        "alert_id long, channel string, target string, status string, payload string, error string",
    )
    notes = rows(reads.recent_notifications(notify.outcome_rows(outcomes, T0), alerts), "alert_id")
    assert [(n["alert_id"], n["metric_name"]) for n in notes] == [(1, "tx_fail_rate"), (777, None)]


def test_metric_lookup(series, rows):
    metrics = series({"dau": {DAY: 10.0, DAY + timedelta(days=1): 11.0}, "x": {DAY: 1.0}})
    got = rows(reads.metric_series(metrics, "dau", DAY, DAY))
    assert got == [{"metric_date": "2026-01-13", "metric_name": "dau", "value": 10.0, "dimensions": "{}"}]


def test_latest_report(report_rows, nothing, one):
    got = one(reads.latest_report(report_rows((DAY, True, 0.625), (DAY - timedelta(days=1), False, 0.1))))
    assert got["report_date"] == "2026-01-13" and got["pass"] is True
    assert json.loads(got["summary"])["confidence"] == 0.625
    assert one(reads.latest_report(nothing(S.DQ_REPORTS))) == {
        "report_date": "1970-01-01", "pass": False, "summary": '{"note":"no reports yet"}',
    }


def test_window_panel(alert_rows, series, report_rows, nothing, rows, one):
    alerts = alert_rows(
        {"metric_date": DAY, "context": {"impact": 4.0, "method": "ewma"}, "risk_score": 1.005},
        {"metric_date": None, "ts": T0 - timedelta(days=1), "context": {"impact": None, "method": None}},
        {"metric_date": DAY + timedelta(days=5), "context": {"impact": 9.0}},
    )
    shown = rows(panels.window_anomalies(alerts, DAY, DAY))
    assert [(r["Impact"], r["Method"]) for r in shown] == [(4.0, "ewma"), (0.0, "n/a")]
    assert panels.window_alerts(alerts, DAY, DAY).count() == 2
    metrics = series({"dau": {DAY: 1.00005, DAY - timedelta(days=1): 2}, "x": {DAY: 3, DAY + timedelta(days=1): 4}})
    assert {r["Metric"]: r["Value"] for r in rows(panels.window_metrics(metrics, DAY - timedelta(days=3), DAY))} == {"dau": 1.0001, "x": 3.0}
    text = one(panels.report_text(report_rows((DAY, True, 0.85), (DAY + timedelta(days=2), False, 0.2)), DAY))
    assert text == {"line": "2026-01-13 | pass=True | confidence=0.85", "cards": ["2026-01-13", "pass=True", "confidence=0.85"]}
    assert one(panels.report_text(nothing(S.DQ_REPORTS)))["line"] == "No DQ reports yet."


def test_stand_in_rows(nothing, one):
    alerts, notes = nothing(S.ALERTS), nothing(S.ALERT_NOTIFICATIONS)
    assert one(panels.window_anomalies(alerts, DAY, DAY)) == {"Metric": "No anomalies", "Impact": 0.0, "Method": "n/a", "Timestamp": ""}
    assert one(panels.recent_anomalies(alerts))["Metric"] == "No anomalies"
    assert one(panels.recent_alerts_table(alerts))["Alert"] == "No recent alerts"
    assert one(panels.window_metrics(nothing(S.METRICS_DAILY), DAY, DAY)) == {"Metric": "No data", "Value": 0.0}
    assert one(panels.notifications_table(notes, alerts)) == {
        "Channel": "-", "Target": "-", "Status": "n/a", "Alert": "No notifications", "Severity": "", "Sent At": "",
    }
    risk = one(overview.risk_table(overview.top_risks_recent(alerts)))
    assert risk == {"Risk": "No material risks", "Severity": "INFO", "Score": 0.0, "Summary": "Operating within expected thresholds."}


def test_recent_panel(alert_rows, series, rows):
    alerts = alert_rows(*[{"ts": T0 + timedelta(minutes=i), "context": {"impact": float(i)}} for i in range(7)])
    assert [r["Impact"] for r in rows(panels.recent_anomalies(alerts))] == [6.0, 5.0, 4.0, 3.0, 2.0]
    metrics = series({"dau": {DAY: 5}, "tx_completed_count": {DAY: 6}, "latency_p95_ms": {DAY - timedelta(days=1): 7}})
    assert rows(panels.recent_metrics(metrics, DAY)) == [{"Metric": "dau", "Value": 5.0}]
