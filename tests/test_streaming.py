import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import kpis
from tidewatch.sources.bodies import bodies_from_kafka, read_bodies, stream_bodies
from tidewatch.sources.tables import Tables
from tidewatch.streaming import ingest, kpis as stream_kpis, provisional, routing

UUID = "3f2504e0-4f89-11d3-9a0c-{:012x}"


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def deliver(folder, name, *events):
    body = json.dumps({"events": list(events)})
    line = json.dumps({"batch_id": name, "received_at": "2026-01-13T12:00:00Z", "body": body})
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(line + "\n")


def event(n, day="2026-01-13", **change):
    return {
        "event_id": UUID.format(n), "ts_event": f"{day}T09:00:00Z", "event_type": "transaction_completed",
        "source_system": "web", "user_id": f"u{n % 3}", "value": float(n), **change,
    }


def test_stream_of_bodies_is_exact_across_batches(spark, tables, tmp_path, rows):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    deliver(landing, "b1", event(1), event(2), event(2))
    ingest.ingest_stream(tables, stream_bodies(spark, str(landing)), checkpoint).awaitTermination()
    deliver(landing, "b2", event(2), event(3), event(4, event_type="x"))
    ingest.ingest_stream(tables, stream_bodies(spark, str(landing)), checkpoint).awaitTermination()
    assert sorted(r["event_id"] for r in rows(tables.read("events_raw"))) == [UUID.format(i) for i in (1, 2, 3)]
    reasons = sorted(r["reason"] for r in rows(tables.read("events_quarantine")))
    assert reasons == ["duplicate_event_id", "duplicate_event_id", "validation_error"]
    assert tables.read("audit_log").count() == 2
    assert read_bodies(spark, str(landing)).count() == 2


def test_a_body_that_comes_again_in_a_later_micro_batch_leaves_its_own_rows(spark, tables, tmp_path, rows):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    for round_ in range(3):
        deliver(landing, "b1", event(1), event(2, event_type="x"))
        (landing / "b1.json").rename(landing / f"copy{round_}.json")
        ingest.ingest_stream(tables, stream_bodies(spark, str(landing)), checkpoint).awaitTermination()
    reasons = sorted(r["reason"] for r in rows(tables.read("events_quarantine")))
    assert reasons == ["duplicate_event_id"] * 2 + ["validation_error"] * 3
    assert tables.read("events_raw").count() == 1 and tables.read("audit_log").count() == 3
    # The last micro-batch is repeated, as after a crash before its commit.
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for old in (tmp_path / "checkpoint" / "commits").glob(f"*{last}*"):
        old.unlink()
    ingest.ingest_stream(tables, stream_bodies(spark, str(landing)), checkpoint).awaitTermination()
    assert tables.read("events_quarantine").count() == 5 and tables.read("audit_log").count() == 3


def test_kpi_stream_recomputes_touched_days(spark, tables, tmp_path, events, rows):
    source, checkpoint = str(tmp_path / "accepted"), str(tmp_path / "checkpoint")
    stream = spark.readStream.schema(S.EVENTS_RAW)

    def arrive(*given):
        events([
            (f"e{n}", f"2026-01-{day:02d} 10:00:00", "transaction_completed", "web", f"u{n}", 1) for n, day in given
        ]).write.mode("append").parquet(source)
        stream_kpis.kpi_stream(tables, stream.parquet(source), checkpoint).awaitTermination()
        return {
            r["metric_date"].day: r["value"] for r in rows(tables.read("metrics_daily"))
            if r["metric_name"] == "tx_completed_count"
        }

    assert arrive((1, 12), (2, 13)) == {12: 1.0, 13: 1.0}
    # A late event of the 12th changes only that day.
    assert arrive((3, 12), (4, 14)) == {12: 2.0, 13: 1.0, 14: 1.0}
    batch = kpis.kpi_rows(kpis.daily_kpis(tables.read("events_raw")))
    keep = ["metric_date", "metric_name", "value"]
    assert rows(batch.select(*keep), *keep) == rows(tables.read("metrics_daily").select(*keep), *keep)


def test_a_repeated_micro_batch_changes_nothing(spark, tables, events, rows):
    batch = events([(f"e{n}", "2026-01-13 10:00:00", "transaction_completed", "web", f"u{n}", n) for n in range(20)])
    for _ in range(2):
        stream_kpis.recompute_touched_days(tables, batch, datetime(2026, 1, 14))
    assert tables.read("events_raw").count() == 20
    count = tables.read("metrics_daily").where("metric_name = 'tx_completed_count'")
    assert [r["value"] for r in rows(count)] == [20.0]


@pytest.fixture
def arriving(spark):
    """Rows ``(number, day of January 2026, id)`` as a micro-batch; a null id is invalid, day 99 lies in the future."""

    def build(*given):
        rows = []
        for seq, (day, name) in enumerate(given):
            moment = datetime(2026, 1, 13, 12) if day == 99 else datetime(2026, 1, day, 10)
            happened = datetime(2027, 1, 1) if day == 99 else moment
            rows.append((
                str(given), seq, name and UUID.format(name), happened, moment, "transaction_completed", "web", "u", float(seq),
                None, "{}",
            ))
        return spark.createDataFrame(
            rows, "batch_id string, seq long, event_id string, ts_event timestamp, ts_ingested timestamp, "
            "event_type string, source_system string, user_id string, value double, measurement_uncertainty double, "
            "properties string",
        )

    return build


BATCHES = [
    [(1, 1), (1, 1), (2, 2), (99, 3), (3, None)],
    [(1, 1), (12, 4), (5, 5)],
    # The 12th is the newest day now: the 5th and before are closed.
    [(5, 6), (1, 2), (6, 7), (12, 4), (13, 4), (5, None)],
    [(6, 7), (6, 8), (4, 9), (14, 10)],
]
OUTCOMES = {
    0: ["duplicate_event_id", "ok", "ok", "ok", "validation_error"], 1: ["duplicate_event_id", "ok", "ok"],
    2: ["duplicate_event_id", "duplicate_event_id", "late", "late", "ok", "validation_error"],
    3: ["late", "late", "late", "ok"],
}


def outcomes(routed):
    found = {}
    for r in routed.rows().collect():
        found.setdefault(r.batch, []).append(r.reason)
    return {n: sorted(reasons) for n, reasons in found.items()}


@pytest.mark.parametrize("snapshot", [32, 2])
def test_every_row_of_a_stream_has_one_outcome(spark, tmp_path, arriving, rows, monkeypatch, snapshot):
    monkeypatch.setattr(routing, "SNAPSHOT", snapshot)
    routed = routing.RoutedStream(spark, str(tmp_path / "routed"), 7)
    with pytest.raises(ValueError):
        routed.rows()
    assert routed.claim() is None and routed.backfill_days().count() == 0
    for number, given in enumerate(BATCHES):
        # A repeated micro-batch changes nothing.
        for _ in range(2):
            routed.route(arriving(*given), number)
    assert outcomes(routed) == OUTCOMES
    assert routed.newest_before(1) == date(2026, 1, 3 - 1) and routed.newest_before(9) == date(2026, 1, 14)
    assert rows(routed.backfill_days(), "event_date") == [
        {"event_date": date(2026, 1, d), "late_rows": n} for d, n in ((1, 1), (4, 1), (5, 1), (6, 2))
    ]


@pytest.mark.parametrize("broken", ["_mark", "_open_ids"])
def test_a_micro_batch_that_failed_is_routed_the_same(spark, tmp_path, arriving, monkeypatch, broken):
    routed = routing.RoutedStream(spark, str(tmp_path / "routed"), 7)
    for number, given in enumerate(BATCHES):
        def lost(*_):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(routing.RoutedStream, broken, lost)
            with pytest.raises(OSError):
                routed.route(arriving(*given), number)
        routed.route(arriving(*given), number)
    assert outcomes(routed) == OUTCOMES


def test_late_rows_are_claimed_worked_off_and_ticked_off(spark, tables, tmp_path, arriving, rows, monkeypatch):
    routed = routing.RoutedStream(spark, str(tmp_path / "routed"), 7)
    for number, given in enumerate(BATCHES):
        routing._store(tables, routed.route(arriving(*given), number), F.lit(datetime(2026, 1, 20)))
    stored = lambda: sorted(int(r["event_id"][-12:], 16) for r in rows(tables.read("events_raw")))
    assert stored() == [1, 2, 3, 4, 5, 7, 10]

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(routing, "refresh_days", lost)
        with pytest.raises(OSError):
            routing.backfill(tables, routed, datetime(2026, 1, 21))
    # The same claim is worked off again, with what has arrived since left for the next.
    routed.route(arriving((6, 11), (6, 8)), 4)
    assert routing.backfill(tables, routed, datetime(2026, 1, 21)) == routing.Claim(0, 3)
    assert stored() == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert rows(routed.backfill_days()) == [{"event_date": date(2026, 1, 6), "late_rows": 2}]
    assert routing.backfill(tables, routed, datetime(2026, 1, 22)) == routing.Claim(4, 4)
    assert stored() == [*range(1, 12)] and routing.backfill(tables, routed, datetime(2026, 1, 23)) is None
    keep = ["metric_date", "metric_name", "value"]
    batch = kpis.kpi_rows(kpis.daily_kpis(tables.read("events_raw")))
    assert rows(batch.select(*keep), *keep) == rows(tables.read("metrics_daily").select(*keep), *keep)
    # Two of the first batch and one each of the others, then the late repeats of 2, 7 and 8.
    refused = rows(tables.read("events_quarantine"))
    assert sorted(r["reason"] for r in refused) == ["duplicate_event_id"] * 7 + ["validation_error"] * 2


def test_provisional_days_take_late_rows(spark, tmp_path, events, rows):
    source, checkpoint = str(tmp_path / "accepted"), str(tmp_path / "cp")
    days = provisional.ProvisionalDays(spark, str(tmp_path / "days"))

    def arrive(*given):
        events(list(given)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(S.EVENTS_RAW).parquet(source)
        provisional.provisional_stream(days, stream, checkpoint).awaitTermination()
        return {r["event_date"].day: r for r in rows(days.read())}

    first = arrive(
        ("a", "2026-01-10 10:00:00", "transaction_completed", "web", "u1", 5),
        ("b", "2026-01-10 11:00:00", "transaction_failed", "web", None, 1),
        ("c", "2026-01-13 10:00:00", "user_access", "web", "u1", 1),
    )
    assert first[10] == {
        "event_date": date(2026, 1, 10), "dau_approx": 1, "tx_completed_count": 1,
        "tx_completed_value": 5.0, "tx_fail_rate": 0.5, "is_open": False,
    }
    assert first[13]["is_open"] and set(first) == {10, 13}
    late = arrive(("d", "2026-01-10 12:00:00", "transaction_completed", "web", "u2", 2))
    assert (late[10]["dau_approx"], late[10]["tx_completed_value"], late[10]["is_open"]) == (2, 7.0, False)
    days.add(events([("e", "2026-01-10 12:00:00", "user_access", "web", "u3", 2)]), 2)
    assert {r["event_date"].day: r["dau_approx"] for r in rows(days.read())} == {10: 2, 13: 1}


def test_provisional_users_lie_within_the_sketchs_error(spark, tmp_path, events, rows):
    days = provisional.ProvisionalDays(spark, str(tmp_path / "days"), entries=8)
    day = spark.range(20_000).selectExpr(
        "timestamp '2026-01-12 10:00:00' AS ts_event", "timestamp '2026-01-12 10:00:01' AS ts_ingested",
        "'user_access' AS event_type", "concat('u', id % 6000) AS user_id", "1.0D AS value",
    )
    for number in range(1, 11):
        days.add(day.where(f"hash(value, user_id) % 10 = {number - 1} OR rand({number}) < 0.2"), number)
    whole = provisional.ProvisionalDays(spark, str(tmp_path / "whole"), entries=8)
    whole.add(day, 1)
    merged, once = rows(days.read())[0]["dau_approx"], rows(whole.read())[0]["dau_approx"]
    assert abs(merged - 6000) <= days.error() * 6000 and abs(once - 6000) <= days.error() * 6000
    future = events([("f", "2027-01-01 00:00:00", "user_access", "web", "u", 1)]).withColumn("ts_ingested", F.lit(datetime(2026, 1, 12)))
    days.add(future, 11)
    assert {r["event_date"].year: r["is_open"] for r in rows(days.read())} == {2026: True, 2027: True}
    assert provisional.ProvisionalDays(spark, str(tmp_path / "none")).read().count() == 0


def test_kafka_records_become_bodies(spark, one):
    records = spark.createDataFrame(
        [(bytearray(b'{"events":[]}'), "t", 3, 42, datetime(2026, 1, 13))],
        "value binary, topic string, partition int, offset long, timestamp timestamp",
    )
    assert one(bodies_from_kafka(records)) == {
        "batch_id": "t-3-42", "received_at": datetime(2026, 1, 13), "body": '{"events":[]}',
    }
