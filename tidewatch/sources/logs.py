"""Logs by day: appends as runs, and closed days compacted while others read and append.

Every append is a run, a folder of its own with a folder per day.  A compaction
rewrites the days that have closed since the last one, from all runs it sees,
into few files, as a run of its own.  It counts once it is complete, and from
then on the runs it saw are read for open days only; late rows of a closed day
come in later runs and are read from there until the next compaction takes
them.  A run that has only closed days goes with the compaction after the next
one at the earliest, so readers that planned on it finish.  One compaction runs
at a time, beside any number of readers and appends.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructType

from tidewatch.sources.staging import file_system, is_complete

_APPEND, _COMPACTED, _SEEN = "run=a-", "run=c-", "seen-"
# Folder of rows without a day: their day never closes.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Compaction:
    """Compaction ``number`` took the days before ``closed`` of the runs in ``seen``."""

    number: int
    closed: date
    seen: frozenset[str]

    @property
    def run(self) -> str:
        return f"{_COMPACTED}{self.number:06d}-{self.closed}"


class DayLog:
    """An append-only table below ``path``, by the day in column ``day``.

    ``of`` is an expression for a day that is no column of the table.  Rows
    without a day are read with all days only, and are never compacted.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, day: str, of: str | None = None, sort: tuple[str, ...] = ()
    ):
        self.spark, self.path, self.schema, self.day, self.of, self.sort = spark, path, schema, day, of, sort
        stored = StructType(list(schema.fields)) if of is None else StructType(list(schema.fields)).add(day, DateType())
        self._stored = stored.add("run", StringType())

    def _names(self, folder: str = "") -> list[str]:
        fs, location = file_system(self.spark, f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []

    def _runs(self) -> list[str]:
        """Complete runs."""
        return sorted(n for n in self._names() if n.startswith("run=") and is_complete(self.spark, f"{self.path}/{n}"))

    def _last(self) -> Compaction | None:
        """The last complete compaction: it saw what those before it saw and is left."""
        runs = [r for r in self._runs() if r.startswith(_COMPACTED)]
        if not runs:
            return None
        number, closed = runs[-1].removeprefix(_COMPACTED).split("-", 1)
        seen = self.spark.read.text(f"{self.path}/{_SEEN}{int(number)}").collect()
        return Compaction(int(number), date.fromisoformat(closed), frozenset(r[0] for r in seen))

    def _days(self, run: str) -> list[tuple[date, str]]:
        """Days of a run and their folders."""
        lead = f"{self.day}="
        days = [n.removeprefix(lead) for n in self._names(run) if n.startswith(lead)]
        return [(date.max if d == _NO_DAY else date.fromisoformat(d), f"{self.path}/{run}/{lead}{d}") for d in days]

    def exists(self) -> bool:
        return bool(self._runs())

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """All rows, or those of the days ``first`` to ``last``; other folders are not read."""
        done = self._last()
        folders = []
        for run in self._runs():
            taken = done.closed if done and run in done.seen else None
            folders += [
                path for day, path in self._days(run)
                if (taken is None or day >= taken) and (first is None or day >= first) and (last is None or day <= last)
            ]
        return self._of(folders)

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self._stored).option("basePath", self.path)
        return reader.parquet(*folders).select(*self.schema.names)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, f"{_APPEND}{uuid.uuid4().hex}")

    def _write(self, rows: DataFrame, run: str) -> None:
        rows = rows.select(*self.schema.names)
        if self.of:
            rows = rows.withColumn(self.day, F.expr(self.of))
        # A day may hold most rows: the writer spreads it over tasks by size.
        rows = rows.hint("rebalance", F.col(self.day)).sortWithinPartitions(self.day, *self.sort)
        rows.write.mode("overwrite").partitionBy(self.day).parquet(f"{self.path}/{run}")

    def compact(self, closed: date) -> None:
        """Rewrite what is new of the days before ``closed``; delete runs that two compactions have done without."""
        before = self._last() or Compaction(0, date.min, frozenset())
        number = before.number + 1
        if closed < before.closed:
            raise ValueError(f"days before {before.closed} are closed already")
        runs = [r for r in self._runs() if r.startswith(_APPEND)]
        taken = [
            path for run in runs for day, path in self._days(run)
            if day < closed and (run not in before.seen or day >= before.closed)
        ]
        # What an unfinished compaction left under this number is replaced.
        for name in self._names():
            if name.startswith(f"{_COMPACTED}{number:06d}-"):
                self._delete(name)
        schema = "run string"
        self.spark.createDataFrame([(r,) for r in runs], schema).coalesce(1).write.mode("overwrite").text(f"{self.path}/{_SEEN}{number}")
        self._write(self._of(taken), Compaction(number, closed, frozenset(runs)).run)
        for run in before.seen & set(runs):
            if all(day < before.closed for day, _ in self._days(run)):
                self._delete(run)

    def _delete(self, name: str) -> None:
        fs, location = file_system(self.spark, f"{self.path}/{name}")
        fs.delete(location, True)
