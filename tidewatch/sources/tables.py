"""The stored tables: Parquet folders with declared schemas.

Daily tables are partitioned by their date.  Raw events and quarantine can only
be appended to.  Upserts rewrite the touched dates: the merged rows are staged
first, then swapped in by dynamic partition overwrite, so a failed run can be
repeated.  Upsert tables without a date are a base with deltas
(``sources/keyed.py``): an upsert writes its own rows only, and counts once they
are complete.  Quarantine and the audit log are kept by day, as runs that are compacted
once their days are closed (``sources/logs.py``).  There is no transaction across tables.

``event_ids`` is an index on raw events (``sources/ids.py``).  An append of
events notes its ids first, writes the events and confirms the note last; what a
failed append left noted is settled by the next one against the events of the
noted dates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewatch import schemas as S
from tidewatch.operators.merge import merge
from tidewatch.sources.ids import BUCKET_IDS, IdIndex
from tidewatch.sources.keyed import KeyedTable
from tidewatch.sources.logs import DayLog
from tidewatch.sources.staging import file_system, stage


@dataclass(frozen=True)
class Table:
    schema: StructType
    keys: tuple[str, ...] = ()
    partition: str | None = None
    append_only: bool = False
    keep: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()
    # Logs by day: the date column, or an expression where there is none.
    day_of: str | None = None

    @property
    def log(self) -> bool:
        return self.day_of is not None

    @property
    def keyed(self) -> bool:
        return self.partition is None and not self.append_only


TABLES = {
    "events_raw": Table(
        S.EVENTS_RAW, ("event_id",), "event_date", append_only=True, sort=("event_type", "ts_event")
    ),
    "events_quarantine": Table(
        S.EVENTS_QUARANTINE, ("quarantine_id", "ts_ingested", "reason"), append_only=True, sort=("reason",), day_of="ingest_date"
    ),
    "metrics_daily": Table(
        S.METRICS_DAILY, ("metric_date", "metric_name", "dimensions"), "metric_date"
    ),
    "dq_reports": Table(S.DQ_REPORTS, ("report_date",), "report_date"),
    "alerts": Table(S.ALERTS, ("alert_id",), "metric_date"),
    "alert_actions": Table(S.ALERT_ACTIONS, ("alert_id", "action_ts", "seq"), append_only=True),
    "alert_notifications": Table(
        S.ALERT_NOTIFICATIONS,
        ("alert_id", "channel", "target"),
        keep=("notification_id", "created_at"),
    ),
    "audit_log": Table(S.AUDIT_LOG, ("audit_id", "ts", "action"), append_only=True, sort=("ts",), day_of="to_date(ts)"),
    "anomaly_rules": Table(S.ANOMALY_RULES, ("rule_name",)),
    "request_log": Table(S.REQUEST_LOG, (), append_only=True),
}


class Tables:
    """Read, append and upsert below one root folder."""

    def __init__(self, spark: SparkSession, root: str, bucket_ids: int = BUCKET_IDS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.ids = IdIndex(spark, self.path("event_ids"), bucket_ids)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        if TABLES[name].keyed:
            return self.keyed(name).exists()
        if TABLES[name].log:
            return self.log(name).exists()
        fs, location = file_system(self.spark, self.path(name))
        return fs.exists(location)

    def keyed(self, name: str) -> KeyedTable:
        table = TABLES[name]
        return KeyedTable(self.spark, self.path(name), table.schema, table.keys, table.keep)

    def log(self, name: str) -> DayLog:
        table = TABLES[name]
        if table.day_of in table.schema.names:
            return DayLog(self.spark, self.path(name), table.schema, table.day_of, sort=table.sort)
        return DayLog(self.spark, self.path(name), table.schema, "log_day", table.day_of, table.sort)

    def compact_logs(self, closed: date) -> None:
        """Rewrite the small files of log days before ``closed``; readers and appends may go on."""
        for name, table in TABLES.items():
            if table.log and self.exists(name):
                self.log(name).compact(closed)

    def read(self, name: str) -> DataFrame:
        """The table, empty with its schema before the first write."""
        schema = TABLES[name].schema
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        if TABLES[name].keyed:
            return self.keyed(name).read()
        if TABLES[name].log:
            return self.log(name).read()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read_touched(self, name: str, rows: DataFrame) -> DataFrame:
        """The stored rows of those partitions (calendar days) that ``rows`` touch."""
        partition = TABLES[name].partition
        # Few values whatever the data; as literals they prune the scan.
        touched = [row[0] for row in rows.select(partition).distinct().collect()]
        return self.read(name).where(F.col(partition).isin(touched))

    def known_ids(self, incoming: DataFrame) -> DataFrame:
        """Ids of ``incoming`` events that are stored; the events are not read."""
        self._settle_ids()
        return self.ids.known(incoming)

    def stored_ids(self, incoming: DataFrame) -> DataFrame:
        """Those ids of ``incoming`` events that are stored, each once.

        Only ids are compared: as long as few come back, the events joined to
        them are not shuffled.
        """
        known = self.known_ids(incoming)
        if not self.ids.runs():
            return known
        ids = incoming.select("event_id").distinct()
        return stage(known.join(ids, "event_id", "left_semi").distinct(), "stored-ids")

    def append(self, name: str, rows: DataFrame) -> None:
        """Append ``rows``; for raw events, which are read twice, index their ids too."""
        if name != "events_raw":
            self._write(name, rows, "append")
            return
        self._settle_ids()
        noted = self.ids.note(rows)
        self._write(name, rows, "append")
        self.ids.confirm(noted)
        self.ids.compact()

    def _settle_ids(self) -> None:
        """Bring the index up to date after a failed append, or make it for events stored without one."""
        for noted in self.ids.unconfirmed():
            self.ids.settle(noted, self.read_touched("events_raw", self.ids.noted(noted)))
        if not self.ids.runs() and self.exists("events_raw"):
            every = self.read("events_raw")
            if stored := every.count():
                self.ids.add(every, stored)

    def append_new(self, name: str, rows: DataFrame) -> None:
        """Append the rows whose key is not stored yet, so that a retry adds nothing."""
        if name == "events_raw":
            self.append(name, rows.join(self.stored_ids(rows), "event_id", "left_anti"))
            return
        table = TABLES[name]
        keys = list(table.keys)
        if table.log:
            # An equal key has an equal day: other days are not read.
            day = F.expr(table.day_of)
            first, last, n = rows.agg(F.min(day), F.max(day), F.count(F.lit(1))).first()
            if not n:
                return
            stored = self.log(name).read(first, last)
        else:
            stored = self.read_touched(name, rows) if table.partition else self.read(name)
        self.append(name, rows.join(stored.select(*keys), keys, "left_anti"))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert ``rows`` or put them in place of equal keys; one row per key."""
        table = TABLES[name]
        if table.append_only:
            raise ValueError(f"{name} is append-only")
        if table.keyed:
            self.keyed(name).upsert(rows)
            return
        columns = table.schema.names
        if not self.exists(name):
            self._write(name, rows, "append")
            return
        incoming = stage(rows.select(*columns), f"{name}-new")
        merged = merge(self.read_touched(name, incoming).select(*columns), incoming, list(table.keys), table.keep)
        self._write(name, stage(merged, f"{name}-merged"), "overwrite")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        table = TABLES[name]
        rows = rows.select(*table.schema.names)
        if table.keyed:
            self.keyed(name).replace(rows if mode == "overwrite" else self.read(name).unionByName(rows))
            return
        if table.log:
            self.log(name).append(rows)
            return
        if table.partition:
            # A date may hold most rows: the writer spreads it over tasks by size.
            rows = rows.hint("rebalance", F.col(table.partition))
        if table.sort:
            lead = [table.partition] if table.partition else []
            rows = rows.sortWithinPartitions(*lead, *table.sort)
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        if table.partition:
            writer = writer.partitionBy(table.partition)
        writer.parquet(self.path(name))
