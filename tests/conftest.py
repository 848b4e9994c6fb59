import os
import sys
from datetime import date, datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidewatch import schemas as S  # noqa: E402
from tidewatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(folder),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    """Builds raw events from ``(id, "YYYY-MM-DD HH:MM:SS", type, source, user, value)``."""

    def build(rows, lag_seconds=5, properties="{}"):
        full = []
        for i, ts, kind, source, user, value in rows:
            moment = datetime.fromisoformat(ts)
            full.append((
                i, moment, moment + timedelta(seconds=lag_seconds), kind, source, user,
                None if value is None else float(value), None, properties, moment.date(),
            ))
        return spark.createDataFrame(full, S.EVENTS_RAW)

    return build


@pytest.fixture
def series(spark):
    """Builds metric rows from ``{metric: {date: value}}``."""

    def build(by_metric, dimensions="{}"):
        rows = [
            (name, float(value), dimensions, datetime(2026, 1, 1), day)
            for name, points in by_metric.items()
            for day, value in points.items()
        ]
        return spark.createDataFrame(rows, S.METRICS_DAILY)

    return build


@pytest.fixture
def daily():
    """``daily(last, [..values..])``: consecutive days ending on ``last``."""

    def build(last: date, values):
        return {last - timedelta(days=len(values) - 1 - i): v for i, v in enumerate(values)}

    return build


@pytest.fixture
def rows():
    def collect(df, *order):
        ordered = df.orderBy(*order) if order else df
        return [r.asDict(recursive=True) for r in ordered.collect()]

    return collect


@pytest.fixture
def one(rows):
    def single(df):
        found = rows(df)
        assert len(found) == 1, found
        return found[0]

    return single


@pytest.fixture
def alert_rows(spark):
    """Builds stored alerts from dicts; missing fields get plain defaults."""

    def build(*given):
        full = []
        for i, g in enumerate(given, start=1):
            context = dict.fromkeys(S.ALERT_CONTEXT.names)
            context.update(method="z_score", impact=0.0)
            context.update(g.get("context", {}))
            row = {
                "alert_id": i,
                "ts": datetime(2026, 1, 14, 1, i % 60),
                "metric_name": "tx_fail_rate",
                "severity": "WARN",
                "rule_version": "v1",
                "risk_score": 5.0,
                "message": "off its week",
                "status": "OPEN",
                "acked_by": None,
                "acked_at": None,
                "resolved_by": None,
                "resolved_at": None,
                "metric_date": date(2026, 1, 13),
                **{k: v for k, v in g.items() if k != "context"},
                "context": context,
            }
            full.append(tuple(row[n] for n in S.ALERTS.names))
        return spark.createDataFrame(full, S.ALERTS)

    return build


@pytest.fixture
def report_rows(spark):
    """Builds stored reports from ``(date, passes, confidence)``."""

    def build(*given):
        full = []
        for day, passes, confidence in given:
            summary = dict.fromkeys(S.DQ_SUMMARY.names)
            summary.update(date=str(day), confidence=confidence)
            full.append((passes, summary, datetime(2026, 1, 14), day))
        return spark.createDataFrame(full, S.DQ_REPORTS)

    return build


@pytest.fixture
def close():
    return lambda value, want: value == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.fixture
def col():
    return F.col
