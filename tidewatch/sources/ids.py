"""Index of ids: which ids a table holds, found without reading the table.

The index is a set of runs, Parquet folders of ids.  Every append adds a run;
runs of about the same size are merged, so their number grows with the logarithm
of the ids.  A run is split into hash buckets of about equal size, twice as many
when it is twice as large, so a look-up reads as much of a large run as of a
small one.  Files are sorted by id and carry Bloom filters: of few ids most
row groups are skipped.

A run counts once its ids are confirmed.  What was only noted, because the
append failed, is settled by the table's own rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.sources.staging import file_system, is_complete, stage

# Ids of one bucket, and runs of one size class that are merged.
BUCKET_IDS = 1 << 20
FAN = 8
# That many ids at most are looked up by literals, which reach the Bloom filters.
LITERALS = 400
# Values of one IN that are still compared one by one in the file's filters.
_IN_VALUES = 10
_ROW_GROUP_BYTES = 8 << 20


def bucket_of(bits: int) -> Column:
    """The first ``bits`` bits of the id's hash."""
    return F.shiftrightunsigned(F.xxhash64("event_id"), 64 - bits) if bits else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Run:
    path: str
    ids: int
    bits: int

    @property
    def size_class(self) -> int:
        return int(math.log(max(self.ids, 1), FAN))


class IdIndex:
    """The ids below one folder."""

    def __init__(self, spark: SparkSession, path: str, bucket_ids: int = BUCKET_IDS):
        self.spark, self.path, self.bucket_ids = spark, path, bucket_ids

    def _names(self, path: str) -> list[str]:
        fs, location = file_system(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []

    def _delete(self, path: str) -> None:
        fs, location = file_system(self.spark, path)
        fs.delete(location, True)

    def _mark(self, path: str, ids: int, bits: int) -> None:
        fs, marker = file_system(self.spark, f"{path}/_ids-{ids}-{bits}")
        fs.create(marker, True).close()

    def _folders(self) -> tuple[list[Run], list[str]]:
        """Confirmed runs, and folders that are not."""
        runs, open_ = [], []
        for name in self._names(self.path):
            path = f"{self.path}/{name}"
            marks = [n for n in self._names(path) if n.startswith("_ids-")]
            if marks:
                ids, bits = marks[0].split("-")[1:]
                runs.append(Run(path, int(ids), int(bits)))
            else:
                open_.append(path)
        return runs, open_

    def runs(self) -> list[Run]:
        return self._folders()[0]

    def _write(self, rows: DataFrame, path: str, ids: int, bits: int) -> None:
        keyed = rows.withColumn("bucket", bucket_of(bits))
        if bits:
            keyed = keyed.hint("rebalance", F.col("bucket"))
        keyed.sortWithinPartitions("bucket", "event_id").write.partitionBy("bucket").option(
            "parquet.bloom.filter.enabled#event_id", "true"
        ).option("parquet.bloom.filter.expected.ndv#event_id", str(min(max(ids, 1000), self.bucket_ids))).option(
            "parquet.block.size", str(_ROW_GROUP_BYTES)
        ).parquet(path)

    def note(self, rows: DataFrame) -> str:
        """Write down ``event_id`` and ``event_date`` of events that are about to be stored."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        self._write(rows.select("event_id", "event_date"), path, self.bucket_ids, 0)
        return path

    def confirm(self, noted: str) -> None:
        """The noted events are stored."""
        ids = self._read(noted).count()
        if ids <= self.bucket_ids:
            self._mark(noted, ids, 0)
        else:
            self.add(self._read(noted), ids)
            self._delete(noted)

    def add(self, rows: DataFrame, ids: int) -> None:
        """A run of ``ids`` ids of stored events."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        bits = max(0, math.ceil(math.log2(max(ids, 1) / self.bucket_ids)))
        self._write(rows.select("event_id"), path, ids, bits)
        self._mark(path, ids, bits)

    def unconfirmed(self) -> list[str]:
        """Notes of appends that failed; those that were never finished are deleted."""
        found = []
        for path in self._folders()[1]:
            if is_complete(self.spark, path):
                found.append(path)
            else:
                # Its events were not begun.
                self._delete(path)
        return found

    def _read(self, path: str, buckets: list[int] | None = None) -> DataFrame:
        reader = self.spark.read.schema("event_id string, event_date date").option("basePath", path)
        if buckets is None:
            return reader.parquet(path)
        return reader.parquet(*[f"{path}/bucket={b}" for b in buckets])

    def noted(self, path: str) -> DataFrame:
        return self._read(path)

    def settle(self, noted: str, stored: DataFrame) -> None:
        """Keep of a failed append's note the ids that are ``stored``."""
        ids = stage(self._read(noted).join(stored.select("event_id"), "event_id", "left_semi"), "settled-ids")
        count = ids.count()
        if count:
            self.add(ids, count)
        self._delete(noted)

    def known(self, incoming: DataFrame) -> DataFrame:
        """Those ids of ``incoming`` that may be stored, and all of them that are.

        Only the buckets are read that the incoming ids fall in.
        """
        runs = self.runs()
        nothing = self.spark.createDataFrame([], "event_id string")
        if not runs:
            return nothing
        ids = stage(incoming.select("event_id").where("event_id is not null").distinct(), "incoming-ids")
        bits = max(run.bits for run in runs)
        # As many values as the largest run has buckets at most.
        touched = [row[0] for row in ids.select(bucket_of(bits).alias("b")).distinct().collect()]
        few = [row[0] for row in ids.limit(LITERALS + 1).collect()]
        found = nothing
        for run in runs:
            there = {n.removeprefix("bucket=") for n in self._names(run.path)}
            wanted = sorted({b >> (bits - run.bits) for b in touched})
            buckets = [b for b in wanted if str(b) in there]
            if buckets:
                found = found.unionByName(self._read(run.path, buckets).select("event_id"))
        if len(few) <= LITERALS:
            groups = [few[i:i + _IN_VALUES] for i in range(0, len(few), _IN_VALUES)]
            wanted = F.lit(False)
            for group in groups:
                wanted = wanted | F.col("event_id").isin(group)
            found = found.where(wanted)
        return found

    def compact(self, fan: int = FAN) -> None:
        """Merge runs of one size class once there are ``fan`` of them.

        A run that is merged and not yet deleted holds its ids twice, which changes no answer.
        """
        by_class: dict[int, list[Run]] = {}
        for run in self.runs():
            by_class.setdefault(run.size_class, []).append(run)
        for group in by_class.values():
            if len(group) >= fan:
                rows = self.spark.createDataFrame([], "event_id string")
                for run in group:
                    rows = rows.unionByName(self._read(run.path).select("event_id"))
                self.add(rows, sum(run.ids for run in group))
                for run in group:
                    self._delete(run.path)
