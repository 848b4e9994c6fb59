import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import scores
from tidewatch.functions.ks import ks_p_value
from tidewatch.operators import bias, drift, quality
from tidewatch.sources.staging import stage_in_slots

DAY = date(2026, 1, 13)
NOW = datetime(2026, 1, 14, 1)


def distance(x, y):
    """Largest gap between the two empirical distribution functions."""
    both = np.concatenate([x, y])
    return max(abs(np.mean(x <= v) - np.mean(y <= v)) for v in both)


def quarantine(spark, *given):
    rows = [(i, ts, reason, "{}", ts.date()) for i, (ts, reason) in enumerate(given)]
    return spark.createDataFrame(rows, S.EVENTS_QUARANTINE)


def test_report_of_two_events_and_one_refused(spark, events, one, close):
    df = events([
        ("a", "2026-01-13 12:00:00", "transaction_completed", "payments", "u1", 10),
        ("b", "2026-01-13 12:00:00", "transaction_completed", "payments", "u2", 12),
    ])
    refused = quarantine(spark, (datetime(2026, 1, 13, 12, 5), "schema_violation"))
    card = quality.scorecard(df, refused, NOW, DAY, DAY)
    report = one(quality.reports(card, NOW))
    summary = report["summary"]
    assert report["pass"] is False and report["report_date"] == DAY
    assert (summary["n_events"], summary["quarantine_total"], summary["malformed_events"]) == (2, 1, 1)
    assert summary["quarantine_by_reason"] == {"schema_violation": 1}
    assert close(summary["confidence"], 0.2357840941039747)
    assert quality.reports(card, NOW).schema["summary"].dataType.names == S.DQ_SUMMARY.names


def test_empty_day_in_a_range_fails(spark, events, rows):
    df = events([("a", "2026-01-13 12:00:00", "user_access", "web", "u1", None)])
    card = quality.scorecard(df, quarantine(spark), NOW, DAY, DAY + timedelta(days=1))
    got = {r["report_date"].day: r for r in rows(card)}
    assert got[13]["pass"] is True and got[14]["pass"] is False
    assert got[14]["n_events"] == 0 and got[14]["confidence"] == 0.0 and got[14]["completeness_rate"] == 0.0
    assert got[14]["freshness_p50_sec"] is None and got[14]["top_property_keys"] == []


def test_totals_missing_and_keys(events, rows, one):
    df = events(
        [
            ("a", "2026-01-13 12:00:00", None, "web", "u", 1),
            ("a", "2026-01-13 13:00:00", "user_access", None, "u", 1),
            (None, "2026-01-13 14:00:00", "user_access", "web", "u", 1),
        ],
        properties='{"currency":"EUR","nested":{"deep":1}}',
    )
    # A null id counts as an event, not as a distinct id.
    assert one(quality.event_totals(df)) == {"event_date": DAY, "n_events": 3, "duplicate_events": 2}
    missing = one(quality.missing_required(df))
    assert [missing[n] for n in (*S.REQUIRED_FIELDS, "total")] == [1, 0, 1, 1, 3]
    keys = rows(quality.top_property_keys(df), "rank")
    assert [(k["key"], k["count"]) for k in keys] == [("currency", 3), ("nested", 3)]


def test_only_twenty_keys(events, one):
    props = "{" + ",".join(f'"k{i:02d}":1' for i in range(25)) + "}"
    df = events([("a", "2026-01-13 12:00:00", "user_access", "web", "u", 1)], properties=props)
    assert quality.top_property_keys(df).count() == 20


def test_future_events_scopes(events, one, rows):
    df = events([
        ("a", "2026-01-14 01:05:00", "user_access", "web", "u", 1),
        ("b", "2026-01-14 01:05:01", "user_access", "web", "u", 1),
        ("c", "2026-01-13 01:00:00", "user_access", "web", "u", 1),
    ])
    assert one(quality.future_events(df, NOW))["future_events"] == 1
    by_day = {r["event_date"].day: r["future_events"] for r in rows(quality.future_events_by_day(df, NOW))}
    assert by_day == {13: 0, 14: 1}


@pytest.mark.parametrize("shift, d, p", [
    (0, 0.0, 1.0), (1, 0.05, 1.0), (5, 0.25, 0.4973423353136104), (10, 0.5, 0.008161678659143069),
])
def test_ks_golden(events, one, shift, d, p, close):
    sample = [(f"c{i}", "2026-01-13 10:00:00", "system_latency", "core", "u", i + shift) for i in range(20)]
    week = [(f"b{i}", "2026-01-10 10:00:00", "system_latency", "core", "u", i) for i in range(20)]
    df = drift.distribution_drift(events(sample + week), start=DAY, end=DAY)
    got = one(df)
    assert close(got["ks_stat"], d) and close(got["p_value"], p)
    assert got["drifted"] is (p < 0.05) and got["name"] == "latency_value"


def test_ks_needs_twenty_values_on_both_sides(events):
    sample = [(f"c{i}", "2026-01-13 10:00:00", "system_latency", "core", "u", i) for i in range(19)]
    week = [(f"b{i}", "2026-01-10 10:00:00", "system_latency", "core", "u", i) for i in range(30)]
    assert drift.distribution_drift(events(sample + week), start=DAY, end=DAY).count() == 0


@pytest.mark.parametrize("slots", [1, 3, 16])
def test_ks_equals_brute_force_for_any_slots(events, rows, slots):
    rng = np.random.default_rng(slots)
    given, by_day = [], {}
    for i in range(12):
        day = DAY + timedelta(days=i)
        if i == 4:
            continue
        values = np.round(rng.gamma(2, 10 + 3 * i, 60), 1)
        values[: 20 * (i % 3)] = 7.5  # a third or two of the day in one value
        by_day[day] = values
        given += [(f"{i}-{k}", f"{day} 10:00:00", "transaction_completed", "web", "u", v) for k, v in enumerate(values)]
    got = {r["report_date"]: r for r in rows(drift.distribution_drift(events(given), slots=slots))}
    for day, values in by_day.items():
        week = [by_day[day - timedelta(days=k)] for k in range(1, 8) if day - timedelta(days=k) in by_day]
        if not week:
            assert day not in got
            continue
        base = np.concatenate(week)
        assert got[day]["ks_stat"] == pytest.approx(distance(values, base), abs=1e-12)
        assert (got[day]["n_current"], got[day]["n_baseline"]) == (len(values), len(base))


@pytest.mark.parametrize("slots", [1, 3])
def test_drift_cells_are_even_on_a_heavy_tail(spark, rows, monkeypatch, slots):
    monkeypatch.setattr(drift, "_CELLS", 60)
    given = spark.range(24_000).selectExpr(
        "'latency_value' AS name", f"date_add(date '2026-01-01', int(id % 10)) AS event_date",
        "if(id < 5, cast('NaN' AS double), power(1 - rand(7), -3.0)) AS value", "1L AS n",
    )
    slotted = stage_in_slots(given, "tail", ["name", "value"], "slot", slots)
    sizes = sorted(r["count"] for r in rows(drift._with_cells(slotted).groupBy("slot", "cell").count()))
    assert 50 <= len(sizes) <= 63 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    ends = drift._with_cells(slotted).groupBy("slot", "cell").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    order = rows(ends, "slot", "cell")
    assert all(a["high"] < b["low"] for a, b in zip(order, order[1:-1]))


def test_p_value_series_stops_early(spark, one):
    df = spark.sql("select 0.3D d, 40L n, 60L m").select(ks_p_value(F.col("d"), F.col("n"), F.col("m")).alias("p"))
    en = math.sqrt(40 * 60 / 100)
    lam = (en + 0.12 + 0.11 / en) * 0.3
    terms = [2 * (-1) ** (k - 1) * math.exp(-2 * lam**2 * k**2) for k in range(1, 100)]
    keep = next(i for i, t in enumerate(terms) if abs(t) < 1e-6) + 1
    assert one(df)["p"] == pytest.approx(sum(terms[:keep]), rel=1e-12)


def test_source_bias_counts_only_days_the_source_appears(events, rows):
    given, n = [], 0
    shares = {"web": [50, 52, 48, 50, 51, 80], "core": [50, 48, 52, 50, 49, 20], "rare": [0, 0, 0, 3, 0, 40]}
    for i in range(6):
        day = DAY + timedelta(days=i)
        for source, counts in shares.items():
            for _ in range(counts[i]):
                given.append((f"e{n}", f"{day} 10:00:00", "user_access", source, "u", 1))
                n += 1
    got = {
        (r["source_system"], r["report_date"]): r for r in rows(bias.source_bias(events(given)))
    }
    last = DAY + timedelta(days=5)
    totals = [sum(c[i] for c in shares.values()) for i in range(6)]
    base = [shares["web"][i] / totals[i] for i in range(5)]
    z = (80 / totals[5] - np.mean(base)) / np.std(base, ddof=1)
    assert got[("web", last)]["z_score"] == pytest.approx(z)
    assert ("rare", last) not in got


def test_pass_needs_every_control(spark, one):
    base = dict(n=100, dup=0.0, comp=1.0, quar=0.0, fut=0, drifted=False, biased=False)

    def verdict(**change):
        v = {**base, **change}
        checks = F.array(F.struct(F.lit(v["drifted"]).alias("drifted")))
        biased = F.array(F.lit(1)) if v["biased"] else F.array().cast("array<int>")
        passes = scores.dq_pass(
            F.lit(v["n"]), F.lit(v["dup"]), F.lit(v["comp"]), F.lit(v["quar"]), F.lit(v["fut"]), checks, biased
        )
        return one(spark.range(1).select(passes.alias("p")))["p"]

    assert verdict() is True and verdict(dup=0.01, comp=0.99, quar=0.01) is True
    for change in (
        {"n": 0}, {"dup": 0.011}, {"comp": 0.989}, {"quar": 0.011}, {"fut": 1}, {"drifted": True}, {"biased": True},
    ):
        assert verdict(**change) is False, change


def test_confidence_golden(spark, one, close):
    got = one(spark.range(1).select(
        scores.dq_confidence(F.lit(3), F.lit(1.0), F.lit(0.0)).alias("three"),
        scores.dq_confidence(F.lit(0), F.lit(1.0), F.lit(0.0)).alias("none"),
        scores.dq_confidence(F.lit(10**6), F.lit(1.0), F.lit(0.0)).alias("many"),
        scores.dq_confidence(F.lit(10), F.lit(1.0), F.lit(3.0)).alias("refused"),
    ))
    assert close(got["three"], 0.49030899869919436)
    assert (got["none"], got["many"], got["refused"]) == (0.0, 1.0, 0.0)


def test_range_equals_single_days(spark, events, rows):
    rng = np.random.default_rng(1)
    given = []
    for i in range(400):
        day = DAY + timedelta(days=int(rng.integers(0, 10)))
        kind = ("transaction_completed", "system_latency")[i % 2]
        given.append((f"e{i}", f"{day} 0{i % 9}:00:00", kind, ("web", "core")[i % 3 == 0], "u", round(float(rng.normal(50, 9)), 2)))
    df, empty = events(given), quarantine(spark)
    whole = {r["report_date"]: r for r in rows(quality.scorecard(df, empty, datetime(2026, 2, 1)))}
    for day in (DAY + timedelta(days=3), DAY + timedelta(days=9)):
        alone = rows(quality.scorecard(df, empty, datetime(2026, 2, 1), day, day))
        assert alone == [whole[day]]


def test_a_scorecard_scans_the_events_four_times(spark, events):
    """Day counts, facts, distinct ids and (in days to come only) future events."""
    df = events([(f"e{n}", f"2026-01-{1 + n % 12:02d} 10:00:00", "system_latency", "web", "u", n) for n in range(120)])
    seen = spark.sparkContext.accumulator(0)

    def passes(_):
        seen.add(1)
        return True

    counted = df.where(F.udf(passes, "boolean").asNondeterministic()("event_date"))
    card = quality.scorecard(counted, spark.createDataFrame([], S.EVENTS_QUARANTINE), datetime(2026, 1, 20))
    assert card.count() == 12 and card.where("n_events = 10").count() == 12
    del card
    seen.value = 0
    quality.scorecard(counted, spark.createDataFrame([], S.EVENTS_QUARANTINE), datetime(2026, 1, 20)).collect()
    assert seen.value <= 4 * 120
