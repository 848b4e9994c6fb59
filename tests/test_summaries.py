from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift, heavy, screening
from tidewatch.streaming import summaries

FIRST = date(2026, 1, 5)


def brute(occurrences, limit):
    by_day = {}
    for day, key in occurrences:
        by_day.setdefault(day, Counter())[key] += 1
    return {
        (day, i + 1): pair
        for day, counter in by_day.items()
        for i, pair in enumerate(sorted(counter.items(), key=lambda p: (-p[1], p[0]))[:limit])
    }


def top(rows, df):
    return {(r["event_date"], r["rank"]): (r["key"], r["count"]) for r in rows(df)}


@pytest.fixture(scope="module")
def occurrences():
    """A day with a few heavy keys among thousands, a flat day, a day of few keys, a day of ties."""
    rng = np.random.default_rng(3)
    heavy_day = [f"h{i}" for i in range(12) for _ in range(400 + 20 * i)] + [f"x{v}" for v in rng.integers(0, 4000, 6000)]
    flat = [f"f{i % 3000}" for i in range(6001)]
    few = ["a", "b", "a", "", "c"]
    ties = [f"t{i}" for i in range(9) for _ in range(300)] + [f"y{i}" for i in range(2000)]
    days = [heavy_day, flat, few, ties]
    return [(FIRST + timedelta(days=i), key) for i, day in enumerate(days) for key in rng.permutation(day).tolist()]


def test_top_keys_equal_brute_force(spark, rows, occurrences):
    keys = spark.createDataFrame(occurrences, "event_date date, key string")
    want = brute(occurrences, 5)
    assert top(rows, heavy.top_keys(keys, 5, tracked=64)) == want
    assert top(rows, heavy.top_keys(keys, 5)) == want
    counted, unsettled = heavy.listed_counts(keys, heavy.key_summaries(keys, 256), 5, 256)
    # Only the flat day and the one whose fifth and later keys tie are counted whole.
    assert FIRST not in unsettled and FIRST + timedelta(days=2) not in unsettled
    assert FIRST + timedelta(days=1) in unsettled
    # Four listed keys per wanted one at most, whatever the number of keys.
    assert max(r["count"] for r in rows(counted.groupBy("event_date").count())) <= 20


def test_a_summary_that_lacks_rows_loses_no_key(spark, rows, occurrences):
    keys = spark.createDataFrame(occurrences, "event_date date, key string")
    late = [(FIRST, "late")] * 3000 + [(FIRST + timedelta(days=9), "new")] * 2
    every = keys.unionByName(spark.createDataFrame(late, keys.schema))
    stale = heavy.key_summaries(keys, 256)
    assert top(rows, heavy.top_keys(every, 5, stale, 256)) == brute(occurrences + late, 5)
    assert FIRST in heavy.listed_counts(every, stale, 5, 256)[1]


def test_keys_odd_rows(spark, rows):
    given = [(None, "a"), (FIRST, None), (FIRST, "b")]
    keys = spark.createDataFrame(given, "event_date date, key string")
    assert top(rows, heavy.top_keys(keys)) == {(FIRST, 1): ("b", 1)}
    assert heavy.top_keys(keys.limit(0)).count() == 0


def test_kept_key_summaries(spark, tmp_path, events, rows):
    def batch(start, count, properties):
        return events(
            [(f"{start}-{i}", "2026-01-05 10:00:00", "user_access", "web", "u", 1) for i in range(count)],
            properties=properties,
        )

    store = summaries.KeySummaries(spark, str(tmp_path / "keys"))
    parts = [batch("a", 3, '{"x":1,"y":{"z":2}}'), batch("b", 2, '{"y":1}'), batch("c", 1, '{"z":1}'), batch("d", 4, None)]
    for number, part in enumerate(parts, start=1):
        store.add(part, number)
    store.add(parts[0], 1)
    assert rows(store.days.read())[0]["n_keys"] == 9
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert top(rows, store.top(every)) == {(FIRST, 1): ("y", 5), (FIRST, 2): ("x", 3), (FIRST, 3): ("z", 1)}
    assert summaries.KeySummaries(spark, str(tmp_path / "none")).top(every.limit(0)).count() == 0


@pytest.fixture(scope="module")
def measured(spark):
    """Three weeks of values: level for long, then shifted, with a value that is a third of a day, infinity and NaN."""
    rng = np.random.default_rng(11)
    given = []
    for i in range(21):
        shift = {9: 0.4, 10: 0.45, 15: 0.12}.get(i, 0.0)
        values = rng.gamma(2.0, 1.0, 700) + shift
        values[: 230 * (i % 2)] = 2.0
        if i > 16:
            values[-40:], values[-60:-40] = np.nan, np.inf
        given += [("system_latency", FIRST + timedelta(days=i), float(v)) for v in values]
    given += [("transaction_completed", FIRST + timedelta(days=i), 1.0) for i in range(3) for _ in range(8)]
    given += [("user_access", FIRST, 1.0), ("system_latency", FIRST, None)]
    return spark.createDataFrame(given, "event_type string, event_date date, value double").cache()


@pytest.mark.parametrize("k", [200, 1000, 4096])
def test_screened_verdicts_equal_exact_ones(rows, measured, k):
    exact = {(r["report_date"], r["name"]): r for r in rows(drift.distribution_drift(measured))}
    screened = {(r["report_date"], r["name"]): r for r in rows(screening.screened_drift(measured, k=k))}
    assert screened.keys() == exact.keys() and len(exact) >= 20
    for key, got in screened.items():
        want = exact[key]
        assert got["drifted"] is want["drifted"], key
        assert (got["n_current"], got["n_baseline"], got["event_type"]) == (
            want["n_current"], want["n_baseline"], want["event_type"])
    bounds = {(r["report_date"], r["name"]): r for r in rows(screening.distance_bounds(screening.day_sketches(measured, k=k), k=k))}
    for key, want in exact.items():
        assert bounds[key]["ks_low"] - 1e-12 <= want["ks_stat"] <= bounds[key]["ks_high"] + 1e-12, key
    by = Counter(r["decided_by"] for r in screened.values())
    # The finer the sketches, the less is counted.
    assert by["sketch"] >= {200: 1, 1000: 8, 4096: 12}[k]


def test_error_bound_holds_for_merged_sketches(spark, one):
    """Twenty thousand values in eight sketches: every rank within the stated error."""
    given = spark.range(20_000).selectExpr("pmod(hash(id), 8) AS part", "pmod(xxhash64(id), 1000003) / 7.0D AS value")
    parts = given.groupBy("part").agg(F.kll_sketch_agg_double("value", 256).alias("s"))
    merged = one(parts.agg(F.kll_merge_agg_double("s").alias("s")).select(
        F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / 50) for i in range(1, 50)])).alias("q")))["q"]
    values = np.sort([r["value"] for r in given.collect()])
    ranks = np.searchsorted(values, merged, side="right") / len(values)
    assert np.max(np.abs(ranks - np.arange(1, 50) / 50)) <= screening.rank_error(256)


def test_no_open_verdict_reads_no_events(spark, rows, measured, monkeypatch):
    """A clear shift and a like week are settled by the sketches alone."""
    day = F.col("event_date")
    few = measured.where((day <= FIRST + timedelta(days=9)) & (day != FIRST + timedelta(days=7)) & (day != FIRST + timedelta(days=8)))
    sketches = screening.day_sketches(few.where(day.isin(FIRST, FIRST + timedelta(days=2), FIRST + timedelta(days=9))))

    def refuse(*_):
        raise AssertionError("events were read")

    monkeypatch.setattr(drift, "value_counts", refuse)
    got = {r["report_date"]: r["drifted"] for r in rows(screening.screened_drift(few, sketches))}
    assert got == {FIRST + timedelta(days=2): False, FIRST + timedelta(days=9): True}


def test_kept_sketches(spark, tmp_path, rows, measured):
    store = summaries.DriftSketches(spark, str(tmp_path / "sketches"), k=1000)
    numbered = measured.withColumn("_part", F.expr("pmod(hash(value, event_date), 5)"))
    for number in range(1, 6):
        store.add(numbered.where(F.col("_part") == number - 1), number)
    store.add(measured, 3)
    exact = {(r["report_date"], r["name"]): r["drifted"] for r in rows(drift.distribution_drift(measured))}
    assert {(r["report_date"], r["name"]): r["drifted"] for r in rows(store.drift(measured))} == exact
    none = summaries.DriftSketches(spark, str(tmp_path / "none"))
    assert none.drift(measured.limit(0)).count() == 0
