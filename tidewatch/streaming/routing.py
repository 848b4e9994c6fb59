"""A stream of events in which no row is lost: each goes to exactly one outcome.

``ok``, ``duplicate_event_id``, ``validation_error`` or ``late``.  A row is late
if its day lies ``delay_days`` or more behind the newest day of the micro-batches
before its own; ids are told apart within the days that are not yet closed, so
the state is the ids of those days.  Late rows wait on a backfill list that a
batch job claims, works off and ticks off.

Everything lies below one folder and is written under the number of its
micro-batch, so a repeated micro-batch finds what it did the first time.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas as S
from tidewatch.operators import validation
from tidewatch.sources.staging import file_system, is_complete, lasting_name, stage
from tidewatch.sources.tables import Tables
from tidewatch.streaming.kpis import refresh_days

LATE = "late"
# After so many micro-batches the ids of the open days are written as one table.
SNAPSHOT = 32


@dataclass(frozen=True)
class Claim:
    """Micro-batches ``first`` to ``last``, whose late rows a job works off."""

    first: int
    last: int


class RoutedStream:
    """What the stream has done so far, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, delay_days: int = 7):
        if delay_days < 1:
            raise ValueError("a day is open for one day at least")
        self.spark, self.root, self.delay = spark, root.rstrip("/"), timedelta(days=delay_days)

    def name(self) -> str:
        """The stream's own name, the same for good."""
        return lasting_name(self.spark, f"{self.root}/name")

    def _names(self, folder: str) -> list[str]:
        fs, location = file_system(self.spark, f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []

    def _mark(self, folder: str, name: str) -> None:
        """An empty file; its name is what it says."""
        fs, location = file_system(self.spark, f"{self.root}/{folder}/{name}")
        fs.create(location, True).close()

    def _rows_path(self, number: int) -> str:
        return f"{self.root}/rows/batch={number}"

    def newest_before(self, number: int) -> date | None:
        """The newest day of the micro-batches before ``number``."""
        marks = dict(name.split("=") for name in self._names("newest"))
        days = [date.fromisoformat(day) for n, day in marks.items() if int(n) < number]
        return max(days, default=None)

    def last_batch(self) -> int:
        """The last micro-batch that was routed to the end; -1 before the first."""
        return max((int(name.split("=")[0]) for name in self._names("done")), default=-1)

    def rows(self, *reasons: str, first: int = 0, last: int | None = None) -> DataFrame:
        """Routed rows of some outcomes (default: all), with ``batch``, ``errors`` and ``reason``."""
        last = self.last_batch() if last is None else last
        paths = [self._rows_path(n) for n in range(first, last + 1) if is_complete(self.spark, self._rows_path(n))]
        if not paths:
            raise ValueError("no micro-batch has been routed there")
        rows = self.spark.read.option("basePath", f"{self.root}/rows").parquet(*paths)
        return rows.where(F.col("reason").isin(*reasons)) if reasons else rows

    # --- routing -----------------------------------------------------------

    def _open_ids(self, number: int, closed: date | None) -> DataFrame:
        """Ids of the days after ``closed`` from the micro-batches before ``number``."""
        names = [n.split("-") for n in self._names("ids")]
        before = [(int(n), kind) for kind, n in names if int(n) < number and is_complete(self.spark, f"{self.root}/ids/{kind}-{n}")]
        whole = max((n for n, kind in before if kind == "all"), default=-1)
        paths = [f"{self.root}/ids/{kind}-{n}" for n, kind in before if (n, kind) == (whole, "all") or kind == "new" and n > whole]
        if not paths:
            return self.spark.createDataFrame([], "event_id string, event_date date")
        ids = self.spark.read.schema("event_id string, event_date date").parquet(*paths)
        return ids if closed is None else ids.where(F.col("event_date") > F.lit(closed))

    def route(self, batch: DataFrame, number: int) -> DataFrame:
        """Judge micro-batch ``number``; a repeated one gives its first judgement."""
        path, newest = self._rows_path(number), self.newest_before(number)
        closed = None if newest is None else newest - self.delay
        if not is_complete(self.spark, path):
            rows = stage(batch, "routed")
            day = F.to_date("ts_event")
            late = F.lit(False) if closed is None else F.coalesce(day <= F.lit(closed), F.lit(False))
            checked = validation.check_events(rows).withColumn("_late", late & (F.size("errors") == 0))
            timely = checked.where("not _late").select(*rows.columns)
            judged = validation.classify(timely, self._open_ids(number, closed)).unionByName(
                checked.where("_late").select(*rows.columns, "errors", F.lit(LATE).alias("reason"))
            )
            judged.withColumn("event_date", day).write.mode("overwrite").partitionBy("reason").parquet(path)
        # One micro-batch: its rows are read back, not judged again.
        judged = self.spark.read.parquet(path)
        kept = judged.where(F.col("reason") == validation.OK).select("event_id", "event_date")
        kept.write.mode("overwrite").parquet(f"{self.root}/ids/new-{number}")
        # An event from the future does not close days.
        grace = F.make_dt_interval(mins=F.lit(S.FUTURE_GRACE_MINUTES))
        moves = (F.col("reason") != validation.INVALID) & (F.col("ts_event") <= F.col("ts_ingested") + grace)
        seen = judged.agg(F.max(F.when(moves, F.col("event_date")))).first()[0]
        days = [d for d in (newest, seen) if d]
        if days:
            self._mark("newest", f"{number}={max(days)}")
        whole = f"{self.root}/ids/all-{number}"
        if (number + 1) % SNAPSHOT == 0 and not is_complete(self.spark, whole):
            self._open_ids(number + 1, closed).write.mode("overwrite").parquet(whole)
        waiting = judged.where(F.col("reason") == LATE).count()
        self._mark("done", f"{number}={waiting}")
        return judged

    # --- the backfill list -------------------------------------------------

    def backfill_days(self) -> DataFrame:
        """Days with late rows that no finished backfill has covered, and how many."""
        first = self._worked_off() + 1
        schema = "event_date date, late_rows long"
        if first > self.last_batch():
            return self.spark.createDataFrame([], schema)
        late = self.rows(LATE, first=first)
        return late.groupBy("event_date").agg(F.count(F.lit(1)).alias("late_rows"))

    def _worked_off(self) -> int:
        """The last micro-batch whose late rows are worked off."""
        return max((int(n.split("-")[1]) for n in self._names("backfilled")), default=-1)

    def claim(self) -> Claim | None:
        """The late rows to work off now: those of a claim that was not ticked off, else all new ones."""
        first, last = self._worked_off() + 1, self.last_batch()
        begun = [Claim(*map(int, n.split("-"))) for n in self._names("claims")]
        for claim in begun:
            if claim.first == first:
                return claim
        late = dict(n.split("=") for n in self._names("done"))
        if not any(int(late.get(str(n), 0)) for n in range(first, last + 1)):
            return None
        self._mark("claims", f"{first}-{last}")
        return Claim(first, last)

    def tick(self, claim: Claim) -> None:
        """The claim is worked off."""
        self._mark("backfilled", f"{claim.first}-{claim.last}")


def route_stream(routed: RoutedStream, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Route all rows that have arrived; ``routed.rows()`` has them, each once."""

    def work(batch: DataFrame, number: int) -> None:
        routed.route(batch, number)

    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _store(tables: Tables, judged: DataFrame, moment, origin: str | None = None) -> None:
    """Accepted rows into the events, refused ones into quarantine, and the KPIs of the touched days."""
    tables.append_new("events_quarantine", validation.refused(judged.where(F.col("reason") != LATE), origin))
    kept = stage(validation.accepted(judged), "accepted")
    tables.append_new("events_raw", kept)
    refresh_days(tables, kept, moment)


def ingest_routed(tables: Tables, routed: RoutedStream, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Route a stream and store what is in time; late rows wait for ``backfill``."""
    name = routed.name()

    def work(batch: DataFrame, number: int) -> None:
        _store(tables, routed.route(batch, number), F.current_timestamp(), f"{name}/{number}")

    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def backfill(tables: Tables, routed: RoutedStream, as_of: datetime) -> Claim | None:
    """Work off the late rows: judge them against all stored events, store them, refresh their days.

    Returns what was worked off, None if nothing was waiting.  A job that failed
    is repeated with the same rows and the same judgement.
    """
    claim = routed.claim()
    if claim is None:
        return None
    at = f"{routed.root}/judged/{claim.first}-{claim.last}"
    if not is_complete(routed.spark, at):
        late = routed.rows(LATE, first=claim.first, last=claim.last).drop("batch", "reason", "errors", "event_date")
        judged = validation.classify(late, tables.known_ids(late))
        stage(judged, "judged-late", at=at)
    _store(tables, routed.spark.read.parquet(at), F.lit(as_of), f"{routed.name()}/{claim.first}-{claim.last}")
    routed.tick(claim)
    return claim
