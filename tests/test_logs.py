import os
from datetime import date, datetime

import pytest

from tidewatch import schemas as S
from tidewatch.sources.logs import DayLog
from tidewatch.sources.tables import Tables


def entries(spark, *given):
    """Audit rows ``(id, day of January 2026)``."""
    df = spark.createDataFrame([(i, datetime(2026, 1, d, 9)) for i, d in given], "audit_id long, ts timestamp")
    rest = [f.name for f in S.AUDIT_LOG.fields if f.name not in ("audit_id", "ts")]
    return df.selectExpr("*", *[f"cast('x' AS string) AS {c}" for c in rest]).select(
        *S.AUDIT_LOG.names
    ).selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in S.AUDIT_LOG.fields])


def ids(df):
    return sorted(r["audit_id"] for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    return DayLog(spark, str(tmp_path / "log"), S.AUDIT_LOG, "log_day", "to_date(ts)", ("ts",))


def files(log, day):
    return [f for f in log.read(date(2026, 1, day), date(2026, 1, day)).inputFiles()]


def test_readers_and_appends_go_on_during_compaction(spark, log, monkeypatch):
    for n in range(6):
        log.append(entries(spark, (n, 10), (10 + n, 11), (20 + n, 12)))
    assert len(files(log, 10)) == 6
    reader, write = log.read(), DayLog._write

    def slowly(self, rows, run):
        # Another job appends a late row and a new one, and reads, before the compaction is complete.
        if "run=c-" in run:
            write(self, entries(spark, (100, 10), (101, 12)), "run=a-meanwhile")
            assert len(ids(self.read())) == 20
        write(self, rows, run)

    with monkeypatch.context() as patch:
        patch.setattr(DayLog, "_write", slowly)
        log.compact(date(2026, 1, 12))
    everything = [*range(6), *range(10, 16), *range(20, 26), 100, 101]
    assert len(ids(reader)) == 18 and ids(log.read()) == sorted(everything)
    # One file of the closed day, and the late row's.
    assert len(files(log, 10)) == 2 and len(files(log, 11)) == 1 and len(files(log, 12)) == 7
    reader = log.read()
    log.compact(date(2026, 1, 13))
    assert ids(log.read()) == ids(reader) == sorted(everything)
    assert len(files(log, 12)) == 1
    log.compact(date(2026, 1, 13))
    assert ids(log.read()) == sorted(everything)
    assert not [n for n in log._names() if n.startswith("run=a-")]


def test_an_unfinished_compaction_counts_for_nothing(spark, log, monkeypatch):
    log.append(entries(spark, (1, 10), (2, 11)))
    write = DayLog._write

    def broken(self, rows, run):
        write(self, rows, run)
        os.remove(f"{self.path}/{run}/_SUCCESS")
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(DayLog, "_write", broken)
        with pytest.raises(OSError):
            log.compact(date(2026, 1, 11))
    assert ids(log.read()) == [1, 2]
    log.compact(date(2026, 1, 12))
    assert ids(log.read()) == [1, 2]
    with pytest.raises(ValueError):
        log.compact(date(2026, 1, 11))


def test_an_audit_append_reads_its_day_only(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path / "tables"))
    for day in range(10, 16):
        tables.append("audit_log", entries(spark, (day, day)))
    read, opened = DayLog._of, []
    monkeypatch.setattr(DayLog, "_of", lambda self, folders: opened.append(folders) or read(self, folders))
    tables.append_new("audit_log", entries(spark, (12, 12), (50, 12)))
    assert len(opened) == 1 and all("log_day=2026-01-12" in f for f in opened[0])
    tables.append_new("audit_log", entries(spark).limit(0))
    tables.compact_logs(date(2026, 1, 14))
    assert ids(tables.read("audit_log")) == [10, 11, 12, 13, 14, 15, 50]
    tables.append_new("audit_log", entries(spark, (13, 13), (51, 13)))
    assert ids(tables.read("audit_log")) == [10, 11, 12, 13, 14, 15, 50, 51]


def test_quarantine_is_compacted_and_keeps_rows_without_a_day(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))

    def refusals(*given):
        found = [(i, d and datetime(2026, 1, d, 9), "validation_error", "{}", d and date(2026, 1, d)) for i, d in given]
        return spark.createDataFrame(found, S.EVENTS_QUARANTINE)

    def kept():
        return sorted(r["quarantine_id"] for r in tables.read("events_quarantine").collect())

    for n in range(4):
        tables.append_new("events_quarantine", refusals((n, 10), (10 + n, 11)))
    tables.append_new("events_quarantine", refusals((0, 10), (20, None)))
    tables.append_new("events_quarantine", refusals((21, None)))
    tables.append_new("events_quarantine", refusals((21, None)).limit(0))
    everything = [*range(4), *range(10, 14), 20, 21]
    assert kept() == everything
    for _ in range(2):
        tables.compact_logs(date(2026, 1, 11))
        assert kept() == everything
    of_day = tables.read("events_quarantine").where("ingest_date = date '2026-01-10'")
    assert len(of_day.inputFiles()) <= 8 and of_day.count() == 4
    log = tables.log("events_quarantine")
    assert len(files(log, 10)) == 1 and len(files(log, 11)) == 4
    # Filters on the day reach the folders.
    assert "PartitionFilters: [isnotnull(ingest_date" in of_day._jdf.queryExecution().toString()


def test_an_empty_log(spark, log):
    assert log.read().count() == 0 and not log.exists()
    log.compact(date(2026, 1, 11))
    assert log.read().count() == 0
    log.append(entries(spark, (1, 10)))
    assert ids(log.read()) == [1]
