import hashlib
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators.merge import merge
from tidewatch.operators import notify
from tidewatch.plans import daily
from tidewatch.sources import ids, keyed, staging
from tidewatch.sources.staging import stage
from tidewatch.sources.tables import TABLES, Tables

DAY = date(2026, 1, 13)
NOW = datetime(2026, 1, 14, 1)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def metric_rows(spark, *given):
    return spark.createDataFrame(
        [(name, float(v), "{}", NOW, day) for day, name, v in given], S.METRICS_DAILY
    )


def test_missing_table_reads_empty(tables):
    for name, table in TABLES.items():
        df = tables.read(name)
        assert df.count() == 0 and df.schema.names == table.schema.names


def test_upsert_replaces_keys_and_keeps_the_rest(spark, tables, rows):
    before = DAY - timedelta(days=1)
    tables.upsert("metrics_daily", metric_rows(spark, (DAY, "dau", 1), (DAY, "x", 2), (before, "dau", 3)))
    tables.upsert("metrics_daily", metric_rows(spark, (DAY, "dau", 10), (DAY, "y", 4)))
    got = {(r["metric_date"], r["metric_name"]): r["value"] for r in rows(tables.read("metrics_daily"))}
    assert got == {(DAY, "dau"): 10.0, (DAY, "x"): 2.0, (DAY, "y"): 4.0, (before, "dau"): 3.0}


def test_upsert_leaves_other_dates_untouched(spark, tables, tmp_path):
    before = DAY - timedelta(days=1)
    tables.upsert("metrics_daily", metric_rows(spark, (DAY, "dau", 1), (before, "dau", 3)))
    folder = tmp_path / "tables" / "metrics_daily" / f"metric_date={before}"
    files = sorted(p.name for p in folder.iterdir())
    tables.upsert("metrics_daily", metric_rows(spark, (DAY, "dau", 2)))
    assert sorted(p.name for p in folder.iterdir()) == files


def test_append_only_tables_refuse_upserts(tables, events):
    df = events([("a", "2026-01-13 09:00:00", "user_access", "web", "u", 1)])
    for name in ("events_raw", "events_quarantine"):
        with pytest.raises(ValueError):
            tables.upsert(name, df)
    tables.append("events_raw", df)
    tables.append("events_raw", df)
    assert tables.read("events_raw").count() == 2


def test_merge_keeps_first_inserted_columns(spark, rows):
    old = spark.createDataFrame([(1, "a", "first"), (2, "b", "first")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "c", "second"), (3, "d", "second")], "k int, v string, made string")
    got = rows(merge(old, new, ["k"], keep=("made",)), "k")
    assert [(r["k"], r["v"], r["made"]) for r in got] == [(1, "a", "first"), (2, "c", "first"), (3, "d", "second")]


def test_staged_table_is_read_back_not_recomputed(spark):
    df = stage(spark.range(5).withColumn("r", F.rand()), "random")
    assert df.collect() == df.collect()


def feed(events, days=12):
    given, n = [], 0
    for i in range(days):
        day = DAY - timedelta(days=days - 1 - i)
        for k in range(30):
            kind = ("transaction_completed", "transaction_failed", "system_latency")[k % 3]
            if k % 3 == 0 and (i == days - 1 or k < 3 * (i % 3)):
                kind = "transaction_failed"
            given.append((f"e{n}", f"{day} 1{k % 10}:00:00", kind, ("web", "core")[k % 2], f"u{k % (7 + i % 2)}", 10 + (k + i) % 5))
            n += 1
    return events(given)


def test_daily_run_and_rerun(tables, events, rows, spark):
    tables.append("events_raw", feed(events))
    start = DAY - timedelta(days=11)
    due = stage(daily.run_days(tables, NOW, start, DAY, emails="a@x,b@x", webhooks="https://h/1,https://h/2"), "due")
    assert tables.read("dq_reports").count() == 12
    assert tables.read("metrics_daily").count() == 60
    alerts = rows(tables.read("alerts"))
    assert any(a["metric_name"] == "tx_fail_rate" and a["metric_date"] == DAY for a in alerts)
    assert due.count() == 3 * len(alerts)

    outcomes = due.withColumn("status", F.lit("sent")).withColumn("error", F.lit(None).cast("string"))
    daily.store_outcomes(tables, outcomes, NOW)
    again = daily.run_days(tables, NOW + timedelta(hours=1), start, DAY, emails="a@x,b@x", webhooks="https://h/1,https://h/2")
    assert again.count() == 0
    assert tables.read("alerts").count() == len(alerts)
    assert tables.read("metrics_daily").count() == 60 and tables.read("dq_reports").count() == 12


def test_default_day_is_yesterday(tables, events, rows):
    tables.append("events_raw", feed(events, days=2))
    daily.run_days(tables, NOW)
    assert {r["report_date"] for r in rows(tables.read("dq_reports"))} == {DAY}
    with pytest.raises(ValueError):
        daily.run_days(tables, NOW, start=DAY)


def test_acting_on_alerts(tables, events, rows, spark):
    tables.append("events_raw", feed(events))
    daily.run_days(tables, NOW, DAY - timedelta(days=11), DAY)
    first = rows(tables.read("alerts"), "alert_id")[0]["alert_id"]
    actions = spark.createDataFrame(
        [(first, "ACK", "ops-user", NOW, 1), (first, "RESOLVED", "ops-user", NOW + timedelta(hours=1), 2), (-1, "ACK", "x", NOW, 1)],
        S.ALERT_ACTIONS,
    )
    unknown = rows(daily.act(tables, actions))
    assert [u["alert_id"] for u in unknown] == [-1]
    state = {a["alert_id"]: a["status"] for a in rows(daily.current_alerts(tables))}
    assert state[first] == "RESOLVED" and set(state.values()) <= {"OPEN", "RESOLVED"}
    audit = rows(tables.read("audit_log"), "ts")
    assert [(a["action"], a["entity_id"]) for a in audit] == [("alert_ack", str(first)), ("alert_resolve", str(first))]


def test_a_failed_upsert_keeps_the_old_rows(tables, spark, rows):
    def outcome(status, broken=False):
        df = spark.range(3).selectExpr(
            "id AS alert_id", "'webhook' AS channel", "'https://h/1' AS target", f"'{status}' AS status", "'{}' AS payload",
            "cast(if(id = 1 AND " + str(broken).lower() + ", raise_error('lost'), null) AS string) AS error",
        )
        return notify.outcome_rows(df, NOW)

    tables.upsert("alert_notifications", outcome("failed"))
    before = rows(tables.read("alert_notifications"), "alert_id")
    with pytest.raises(Exception, match="lost"):
        tables.upsert("alert_notifications", outcome("sent", broken=True))
    with pytest.raises(Exception, match="lost"):
        tables._write("alert_notifications", outcome("sent", broken=True), "overwrite")
    assert rows(tables.read("alert_notifications"), "alert_id") == before
    for _ in range(3):
        tables.upsert("alert_notifications", outcome("sent"))
    assert {r["status"] for r in rows(tables.read("alert_notifications"))} == {"sent"}
    assert tables.read("alert_notifications").count() == 3


def id_rows(events, *ids):
    return events([(i, "2026-01-13 09:00:00", "user_access", "web", "u", 1) for i in ids])


def known(tables, events, *ids):
    return {r["event_id"] for r in tables.known_ids(id_rows(events, *ids)).collect()}


def bytes_read(spark, work):
    """What ``work`` reads from files, by the file system's own count."""
    def total():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = total()
    work()
    return total() - before


def test_known_ids_come_from_the_index_alone(spark, tables, events):
    tables.append("events_raw", id_rows(events, *[f"e{n}" for n in range(50)]))
    found = tables.known_ids(id_rows(events, "e7", "new"))
    assert "events_raw" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["event_id"] for r in found.collect()} == {"e7"}


@pytest.mark.parametrize("literals", [400, 0])
def test_reads_of_a_delivery_stay_flat_as_history_grows(spark, tmp_path, events, monkeypatch, literals):
    monkeypatch.setattr(ids, "LITERALS", literals)
    tables = Tables(spark, str(tmp_path / "grown"), bucket_ids=500)
    template = id_rows(events, "x")

    def store(first, last):
        made = spark.range(first, last).selectExpr("md5(cast(id AS string)) AS event_id")
        tables.append("events_raw", template.drop("event_id").crossJoin(made).select(*template.columns))

    def look_up():
        probe = spark.sql("SELECT explode(array(md5('5'), md5('77'), 'none', 'other')) AS event_id")
        return {r["event_id"] for r in tables.known_ids(probe).collect()}

    store(0, 10_000)
    few = bytes_read(spark, look_up)
    store(10_000, 100_000)
    many = bytes_read(spark, look_up)
    assert sorted(run.bits for run in tables.ids.runs()) == [5, 8]
    assert many < 3 * few
    found = look_up()
    want = {hashlib.md5(n).hexdigest() for n in (b"5", b"77")}
    assert found == want if literals else found > want


def test_runs_are_merged_and_buckets_split(spark, tmp_path, events):
    tables = Tables(spark, str(tmp_path / "merged"), bucket_ids=10)
    every = [f"e{n}" for n in range(40)]
    for begin in range(0, 40, 2):
        tables.append("events_raw", id_rows(events, *every[begin:begin + 2]))
    runs = tables.ids.runs()
    assert len(runs) < 8 and sum(run.ids for run in runs) == 40 and max(run.bits for run in runs) > 0
    assert known(tables, events, *every, "new", "other") == set(every)


def test_index_follows_the_events_after_a_failed_append(tables, events, monkeypatch):
    def lost(*_):
        raise OSError("lost")

    tables.append("events_raw", id_rows(events, "a"))
    for broken, method, added in ((Tables, "_write", "b"), (ids.IdIndex, "confirm", "c")):
        with monkeypatch.context() as m:
            m.setattr(broken, method, lost)
            with pytest.raises(OSError):
                tables.append("events_raw", id_rows(events, added))
        # Whatever was noted, only stored events are known.
        assert known(tables, events, "a", "b", "c") == ({"a"} if added == "b" else {"a", "c"})
    tables.append("events_raw", id_rows(events, "b"))
    assert known(tables, events, "a", "b", "c") == {"a", "b", "c"} and tables.read("events_raw").count() == 3


def test_an_append_of_new_events_reads_no_events(spark, tables, events, tmp_path):
    tables.append("events_raw", id_rows(events, "a", "b"))
    for part in (tmp_path / "tables" / "events_raw").rglob("*.parquet"):
        part.write_bytes(b"unreadable")
    tables.append_new("events_raw", id_rows(events, "b", "c"))
    assert known(tables, events, "a", "b", "c") == {"a", "b", "c"}
    assert sum(run.ids for run in tables.ids.runs()) == 3


def test_stored_ids_are_those_that_come_back(tables, events):
    assert tables.stored_ids(id_rows(events, "a")).isEmpty()
    tables.append("events_raw", id_rows(events, "a", "b", "c"))
    assert [r["event_id"] for r in tables.stored_ids(id_rows(events, "b", "b", "new", None)).collect()] == ["b"]


def test_events_stored_without_an_index_get_one(tables, events):
    tables._write("events_raw", id_rows(events, "a", "b"), "append")
    assert {r["event_id"] for r in tables.known_ids(id_rows(events, "a", "b")).collect()} == {"a", "b"}


def test_staged_tables_can_be_cleared(spark, events, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda spark: str(tmp_path))
    other = tmp_path / "staged" / "another-application"
    other.mkdir(parents=True)
    stage(id_rows(events, "a"), "cleared")
    own = tmp_path / "staged" / spark.sparkContext.applicationId
    assert own.is_dir()
    staging.clear_staged(spark)
    assert not own.exists() and other.is_dir()


NOTES = TABLES["alert_notifications"]


def outcomes(spark, ids, status, at):
    df = spark.createDataFrame([(i, "webhook", "https://h/1", status, "{}", None) for i in ids],
                               "alert_id long, channel string, target string, status string, payload string, error string")
    return notify.outcome_rows(df, at)


def keyed_notes(spark, tmp_path, **options):
    return keyed.KeyedTable(spark, str(tmp_path / "notes"), NOTES.schema, NOTES.keys, NOTES.keep, **options)


def test_ten_outcomes_write_ten_rows(spark, tables, tmp_path):
    tables.upsert("alert_notifications", outcomes(spark, range(3000), "failed", NOW))
    before = {p for p in (tmp_path / "tables").rglob("*.parquet")}
    daily.store_outcomes(tables, outcomes(spark, range(5, 15), "sent", NOW).withColumn("error", F.lit(None).cast("string")), NOW)
    after = {p for p in (tmp_path / "tables").rglob("*.parquet")}
    assert before <= after and spark.read.parquet(*map(str, after - before)).count() == 10
    read = tables.read("alert_notifications")
    assert read.count() == 3000 and read.where("status = 'sent'").count() == 10


@pytest.mark.parametrize("small, share", [(0, 0.5), (1 << 30, 0.125)])
def test_deltas_equal_plain_upserts_whatever_is_merged(spark, tmp_path, rows, small, share):
    """Random upserts against a dictionary: new bases are written in one case, deltas merged in the other."""
    chance = random.Random(5)
    table, plain, most = keyed_notes(spark, tmp_path, fan=3, small=small, share=share), {}, 0
    for turn in range(14):
        at, ids = NOW + timedelta(hours=turn), chance.sample(range(40), chance.choice([0, 1, 2, 9, 20]))
        table.upsert(outcomes(spark, ids, f"s{turn}", at))
        for i in ids:
            plain[i] = (f"s{turn}", plain[i][1] if i in plain else at)
        most = max(most, len(table.parts()))
    assert {r["alert_id"]: (r["status"], r["created_at"]) for r in rows(table.read())} == plain
    bases = table.parts()[0].base
    assert bases > 1 if small == 0 else bases == 1 and most <= 7


def test_readers_go_on_while_deltas_are_merged(spark, tmp_path, monkeypatch):
    table = keyed_notes(spark, tmp_path, fan=3, small=1 << 30)
    for turn in range(3):
        table.upsert(outcomes(spark, [turn], "failed", NOW))
    reader = table.read()
    table.upsert(outcomes(spark, [7], "failed", NOW))
    assert any(p.last > p.first for p in table.parts())
    assert reader.count() == 3 and table.read().count() == 4
    reader = table.read()
    table.replace(table.read())
    assert reader.count() == 4 and table.parts() == [keyed.Part(2)]


def test_a_merge_that_failed_is_no_part(spark, tmp_path, monkeypatch):
    table = keyed_notes(spark, tmp_path, fan=3, small=1 << 30)
    for turn in range(3):
        table.upsert(outcomes(spark, [turn], "failed", NOW))

    def fail(self, rows, part):
        if part.last > part.first:
            raise OSError("lost")
        return write(self, rows, part)

    write = keyed.KeyedTable._write
    with monkeypatch.context() as patch:
        patch.setattr(keyed.KeyedTable, "_write", fail)
        with pytest.raises(OSError):
            table.upsert(outcomes(spark, [1], "sent", NOW))
    table.upsert(outcomes(spark, [1], "sent", NOW))
    assert {r["alert_id"]: r["status"] for r in table.read().collect()} == {0: "failed", 1: "sent", 2: "failed"}
