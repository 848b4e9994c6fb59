from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import kpis
from tidewatch.operators.percentiles import daily_percentiles


def as_dict(rows):
    return {(r["metric_date"], r["metric_name"]): r["value"] for r in rows}


def test_five_kpis_of_one_day(events, rows):
    df = events([
        ("a", "2026-01-13 09:00:00", "transaction_completed", "payments", "u1", 100),
        ("b", "2026-01-13 09:00:00", "transaction_completed", "payments", "u2", 50),
        ("c", "2026-01-13 09:00:00", "transaction_failed", "payments", "u3", 0),
        ("d", "2026-01-13 09:00:00", "system_latency", "core", "u4", 250),
    ])
    got = as_dict(rows(kpis.kpi_rows(kpis.daily_kpis(df))))
    day = date(2026, 1, 13)
    assert got == {
        (day, "dau"): 4.0,
        (day, "tx_completed_count"): 2.0,
        (day, "tx_completed_value"): 150.0,
        (day, "tx_fail_rate"): pytest.approx(1 / 3),
        (day, "latency_p95_ms"): 250.0,
    }


def test_day_without_latency_has_no_latency_row(events, rows):
    df = events([("a", "2026-01-13 09:00:00", "user_access", "core", None, None)])
    got = as_dict(rows(kpis.kpi_rows(kpis.daily_kpis(df))))
    assert {name: v for (_, name), v in got.items()} == {
        "dau": 0.0, "tx_completed_count": 0.0, "tx_completed_value": 0.0, "tx_fail_rate": 0.0,
    }


def test_backfill_covers_every_day_of_the_range(events, rows):
    df = events([
        ("a", "2026-01-12 10:00:00", "transaction_completed", "payments", "u1", 10),
        ("b", "2026-01-13 10:00:00", "transaction_completed", "payments", "u1", 20),
        ("c", "2026-01-15 10:00:00", "transaction_completed", "payments", "u1", 30),
    ])
    got = as_dict(rows(kpis.backfill(df, date(2026, 1, 12), date(2026, 1, 14))))
    counts = {d.day: v for (d, name), v in got.items() if name == "tx_completed_count"}
    assert counts == {12: 1.0, 13: 1.0, 14: 0.0}


def test_backfill_refuses_a_reversed_range(events):
    df = events([("a", "2026-01-12 10:00:00", "user_access", "core", "u", 1)])
    with pytest.raises(ValueError):
        kpis.backfill(df, date(2026, 1, 13), date(2026, 1, 12))


def test_midnight_belongs_to_the_new_day(events, rows):
    df = events([
        ("a", "2026-01-12 23:59:59.999999", "user_access", "core", "u1", 1),
        ("b", "2026-01-13 00:00:00", "user_access", "core", "u2", 1),
    ])
    assert [r["dau"] for r in rows(kpis.active_users(df), "event_date")] == [1.0, 1.0]


@pytest.mark.parametrize("shape", ["uniform", "ties", "narrow", "heavy"])
def test_percentiles_equal_numpy_beyond_the_sketch(spark, shape, rows):
    """Days larger than the sketch resolution, hence with real brackets."""
    rng = np.random.default_rng(7)
    n = 30_000
    values = {
        "uniform": rng.uniform(-5, 5, n),
        "ties": rng.integers(0, 40, n).astype(float),
        "narrow": 1.7e9 + rng.uniform(0, 1e-3, n),
        "heavy": np.concatenate([np.full(n // 3, 12.5), rng.pareto(1.1, n - n // 3)]),
    }[shape]
    df = spark.createDataFrame(
        [(date(2026, 1, 1 + i % 2), float(v)) for i, v in enumerate(values)], "d date, v double"
    ).repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p51": 0.51, "p95": 0.95, "p100": 1.0}
    for slots in (1, 7):
        got = rows(daily_percentiles(df, "d", F.col("v"), wanted, accuracy=1000, slots=slots), "d")
        assert len(got) == 2
        for k, row in enumerate(got):
            for name, p in wanted.items():
                assert row[name] == pytest.approx(np.quantile(values[k::2], p), rel=1e-12), (name, k)


def test_percentiles_of_short_days(spark, rows):
    df = spark.createDataFrame(
        [(date(2026, 1, 1), 4.0), (date(2026, 1, 1), None), (date(2026, 1, 2), 1.0), (date(2026, 1, 2), 2.0),
         (date(2026, 1, 3), None)],
        "d date, v double",
    )
    got = {r["d"].day: r["p"] for r in rows(daily_percentiles(df, "d", F.col("v"), {"p": 0.95}))}
    assert got == {1: 4.0, 2: pytest.approx(1.95)}


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_of_values_that_are_not_finite(spark, rows, accuracy):
    """NaN ranks last, as it does in the databases that hold such values."""
    inf, nan = float("inf"), float("nan")
    given = {
        1: [*range(90), *[nan] * 10], 2: [*range(99), nan], 3: [nan], 4: [inf, inf, 1.0, -inf], 5: [*range(40), *[inf] * 5, *[nan] * 5],
    }
    df = spark.createDataFrame([(d, float(v)) for d, values in given.items() for v in values], "day int, v double")
    got = rows(daily_percentiles(df, "day", F.col("v"), {"p50": 0.5, "p95": 0.95}, accuracy=accuracy), "day")
    same = lambda a, b: a == pytest.approx(b, nan_ok=True)
    for r in got:
        values = sorted(given[r["day"]], key=lambda v: (v != v, v))
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            low, part = divmod(p * (len(values) - 1), 1)
            a, b = values[int(low)], values[min(int(low) + 1, len(values) - 1)]
            assert same(r[name], a if part == 0 or a == b else a + (b - a) * part), (r, name)
