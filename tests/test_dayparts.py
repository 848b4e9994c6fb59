import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import kpis
from tidewatch.sources import keyed
from tidewatch.sources.tables import Tables
from tidewatch.streaming import dayparts

NOW = datetime(2026, 2, 1)
KINDS = ("system_latency", "system_latency", "transaction_completed", "transaction_failed", "user_access")


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


@pytest.fixture
def parts(spark, tmp_path):
    return dayparts.DayParts(spark, str(tmp_path / "parts"), bucket_ids=50)


def made(events, chance, name, n, days=(11, 12, 13)):
    value = lambda: chance.choice([None, 0.0, -3.5, math.inf, math.nan, chance.expovariate(0.01), chance.expovariate(0.01)])
    return events([
        (f"{name}{k}", f"2026-01-{chance.choice(days)} 10:00:00", chance.choice(KINDS), "web",
         chance.choice([None, *[f"u{i}" for i in range(30)]]), value()) for k in range(n)
    ])


def same(stored, whole):
    def table(df):
        return {(r["metric_date"], r["metric_name"]): r["value"] for r in df.select("metric_date", "metric_name", "value").collect()}

    got, want = table(stored), table(whole)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert (math.isnan(value) and math.isnan(got[key])) or got[key] == pytest.approx(value), key


def test_cells_follow_the_order_of_values(spark):
    chance = random.Random(3)
    given = [0.0, math.inf, -math.inf, math.nan, 5e-324, 1.7e308, -5e-324] + [chance.uniform(-9, 9) * 10 ** chance.randint(-9, 9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in given], "v double").select("v", dayparts.cell_of(F.col("v")).alias("c"))
    got = [r["c"] for r in df.orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 400


def test_kpis_of_added_parts_equal_those_of_the_events(tables, parts, events):
    chance = random.Random(11)
    tables.append("events_raw", made(events, chance, "old", 60))
    for number in range(3):
        batch = made(events, chance, f"b{number}-", 80, days=(11, 12, 13, 14)[: number + 2])
        dayparts.maintain(tables, parts, batch, number, NOW)
        # Repeated, and with events that are stored already.
        dayparts.maintain(tables, parts, batch, number, NOW)
    dayparts.maintain(tables, parts, batch, 3, NOW)
    stored = tables.read("events_raw")
    assert stored.count() == 300
    same(tables.read("metrics_daily"), kpis.kpi_rows(kpis.daily_kpis(stored)))


@pytest.mark.parametrize("broken", ["append", "users", "latencies", "counts", "upsert"])
def test_a_batch_that_failed_anywhere_is_counted_once(tables, parts, events, monkeypatch, broken):
    chance = random.Random(12)
    dayparts.maintain(tables, parts, made(events, chance, "a", 40), 0, NOW)
    batch = made(events, chance, "b", 40)

    def fail(*_):
        raise OSError("lost")

    owner, name = {
        "append": (parts, "_new_users"), "users": (parts.users, "compact"), "latencies": (parts.cells, "add"),
        "counts": (parts.counts, "add"), "upsert": (tables, "upsert"),
    }[broken]
    with monkeypatch.context() as patch:
        patch.setattr(owner, name, fail)
        with pytest.raises(OSError):
            dayparts.maintain(tables, parts, batch, 1, NOW)
    dayparts.maintain(tables, parts, batch, 1, NOW)
    same(tables.read("metrics_daily"), kpis.kpi_rows(kpis.daily_kpis(tables.read("events_raw"))))


def test_a_late_event_does_not_read_its_day(spark, tables, parts, tmp_path):
    day = spark.range(400_000).selectExpr(
        "concat('e', id) AS event_id", "timestamp '2026-01-12 10:00:00' AS ts_event", "timestamp '2026-01-12 10:00:01' AS ts_ingested",
        "if(id % 2 = 0, 'system_latency', 'user_access') AS event_type", "'web' AS source_system", "concat('u', id % 90000) AS user_id",
        "10 + 900 * rand(1) AS value", "cast(null AS double) AS measurement_uncertainty", "'{}' AS properties",
        "date '2026-01-12' AS event_date",
    )
    dayparts.maintain(tables, parts, day, 0, NOW)
    late = day.limit(1).withColumn("event_id", F.lit("late")).withColumn("user_id", F.lit("u5"))
    stored = sum(p.stat().st_size for p in (tmp_path / "tables" / "events_raw").rglob("*.parquet"))
    total = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = total()
    dayparts.maintain(tables, parts, late, 1, NOW)
    assert total() - before < stored / 2
    asked = parts.latencies.read().where("event_date = date '2026-01-12' AND cell IN (1, 2)")
    assert "In(cell, [1,2])" in asked._jdf.queryExecution().toString()
    same(tables.read("metrics_daily"), kpis.kpi_rows(kpis.daily_kpis(tables.read("events_raw"))))


def test_sums_are_merged_by_size_and_added_once(spark, tmp_path):
    table = keyed.SumTable(spark, str(tmp_path / "sums"), "k int, n long", ("k",), fan=3)
    for number in range(1, 9):
        for _ in range(2):
            table.add(spark.range(number).selectExpr("cast(id AS int) AS k", "1L AS n"), number)
    assert {r["k"]: r["n"] for r in table.read().collect()} == {k: 8 - k for k in range(8)}
    assert len(table.parts()) < 8 and table.last() == 8
    table.add(spark.range(0).selectExpr("cast(id AS int) AS k", "1L AS n"), 9)
    assert table.read().count() == 8 and table.last() == 9
    with pytest.raises(ValueError):
        table.upsert(table.read())


def test_parts_of_nothing(tables, parts, events):
    dayparts.maintain(tables, parts, events([]), 0, NOW)
    assert tables.read("metrics_daily").count() == 0
    assert parts.kpis([date(2026, 1, 1)]).count() == 0
