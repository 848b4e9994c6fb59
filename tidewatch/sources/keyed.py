"""Keyed tables without a date: a base and deltas, merged when read.

An upsert writes its own rows only, as a delta beside the base; of equal keys
the row of the newest delta counts.  ``v3`` is base 3, ``v3-0007-0009`` holds
the newest rows of its deltas 7 to 9.  A folder counts once it is complete, so a
failed write changes nothing and can be repeated.

Deltas are merged level by level, as runs of a log-structured table: ``FAN`` of
about the same size become one, so the times a row is rewritten, and the deltas
that are open, grow with the logarithm of their bytes.  When the deltas hold a
``SHARE`` of the base's bytes, all becomes the next base.  What a
merge replaces stays until the next one, for readers that have planned on it.
There is one writer at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewatch.operators.merge import merge
from tidewatch.sources.staging import file_system, is_complete, stage

# Deltas of one size that are merged into one.
FAN = 8
# Part of the base's bytes in deltas from which a new base is written, if they are more than SMALL.
SHARE = 0.125
SMALL = 1 << 20
ROW_GROUP_BYTES = 8 << 20
_NAME = re.compile(r"v(\d+)(?:-(\d+)-(\d+))?$")


@dataclass(frozen=True, order=True)
class Part:
    """A folder: base ``base`` if ``last`` is 0, else its deltas ``first`` to ``last``."""

    base: int
    last: int = 0
    first: int = 0

    @property
    def name(self) -> str:
        return f"v{self.base}-{self.first:04d}-{self.last:04d}" if self.last else f"v{self.base}"

    def covers(self, other: "Part") -> bool:
        return self != other and self.base == other.base and 0 < self.first <= other.first and other.last <= self.last


class KeyedTable:
    """One keyed table below ``path``."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], keep: tuple[str, ...] = (),
        fan: int = FAN, share: float = SHARE, small: int = SMALL,
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.keep = list(keys), tuple(keep)
        self.fan, self.share, self.small = fan, share, small

    def _complete(self) -> list[Part]:
        fs, location = file_system(self.spark, self.path)
        if not fs.exists(location):
            return []
        found = [_NAME.match(status.getPath().getName()) for status in fs.listStatus(location)]
        parts = [Part(int(m[1]), int(m[3] or 0), int(m[2] or 0)) for m in found if m]
        return sorted(p for p in parts if is_complete(self.spark, f"{self.path}/{p.name}"))

    def parts(self) -> list[Part]:
        """The base in use and its deltas, oldest first; none before the first write."""
        complete = self._complete()
        bases = [p for p in complete if not p.last]
        if not bases:
            return []
        deltas = [p for p in complete if p.last and p.base == bases[-1].base]
        return [bases[-1], *[p for p in deltas if not any(o.covers(p) for o in deltas)]]

    def exists(self) -> bool:
        return bool(self.parts())

    def read(self) -> DataFrame:
        """The rows in force, empty before the first write."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        base = self._of(parts[0])
        # Against the base, which is not shuffled as long as the deltas are small enough to be sent to it.
        return merge(base, self._newest(parts[1:]), self.keys) if parts[1:] else base

    def upsert(self, rows: DataFrame) -> None:
        """Insert ``rows`` or put them in place of equal keys; one row per key.

        Columns in ``keep`` stay as first inserted: of the stored table only
        these and the keys are read.
        """
        rows = rows.select(*self.schema.names)
        parts = self.parts()
        if not parts:
            self.replace(rows)
            return
        if self.keep:
            rows = stage(rows, "keyed-new")
            stored = self.read().select(*self.keys, *[F.col(c).alias(f"_{c}") for c in self.keep])
            stored = stored.join(rows.select(*self.keys), self.keys, "left_semi")
            rows = rows.join(stored, self.keys, "left").select(*[
                F.coalesce(f"_{c}", c).alias(c) if c in self.keep else F.col(c) for c in rows.columns
            ])
        number = parts[-1].last + 1
        self._write(rows, Part(parts[0].base, number, number))
        self.compact()

    def replace(self, rows: DataFrame) -> None:
        """Write ``rows`` as the next base; what lies before the base in use goes."""
        complete = self._complete()
        used = max((p.base for p in complete if not p.last), default=0)
        self._write(rows.select(*self.schema.names), Part(used + 1))
        self._delete(p for p in complete if p.base < used)

    def compact(self) -> None:
        """Merge deltas of one size, and all into a new base if the deltas have grown to a share of it."""
        parts = self.parts()
        base, deltas = parts[0], parts[1:]
        if sum(map(self._bytes, deltas)) > max(self.share * self._bytes(base), self.small):
            self.replace(self.read())
        else:
            self._merge_levels(deltas)

    def _merge_levels(self, deltas: list[Part]) -> None:
        # From the newest back, a delta counts as large as any newer one: the run to merge has no gap.
        level, most = [], 0
        for p in reversed(deltas):
            most = max(most, int(math.log(max(self._bytes(p), 1), self.fan)))
            level.insert(0, most)
        full = [k for k in set(level) if level.count(k) >= self.fan]
        if not full:
            return
        run = deltas[level.index(max(full)):]
        base = run[0].base
        before = [p for p in self._complete() if p.base == base and p.last and p not in deltas]
        self._write(self._newest(run), Part(base, run[-1].last, run[0].first))
        self._delete(before)

    def _newest(self, deltas: list[Part]) -> DataFrame:
        """Of each key in ``deltas`` the row of the newest."""
        if len(deltas) == 1:
            return self._of(deltas[0])
        every = None
        for place, part in enumerate(deltas):
            rows = self._of(part).withColumn("_place", F.lit(place))
            every = rows if every is None else every.unionByName(rows)
        newest = every.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(
            F.max_by(F.struct(*self.schema.names), "_place").alias("row")
        )
        return newest.select("row.*")

    def _of(self, part: Part) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{part.name}")

    def _bytes(self, part: Part) -> int:
        fs, location = file_system(self.spark, f"{self.path}/{part.name}")
        return fs.getContentSummary(location).getLength()

    def _write(self, rows: DataFrame, part: Part) -> None:
        if part.last:
            # Deltas are small: few files.
            rows = rows.hint("rebalance")
        # What an unfinished write left under this name is replaced.
        rows.write.mode("overwrite").parquet(f"{self.path}/{part.name}")

    def _delete(self, parts) -> None:
        for part in parts:
            fs, location = file_system(self.spark, f"{self.path}/{part.name}")
            fs.delete(location, True)


class SumTable(KeyedTable):
    """Counts, sums or sketches by key, to which numbered deltas add.

    All columns but the keys are summed when read, and where deltas are merged;
    ``combine`` names other aggregates for some (column -> aggregate of it).
    A delta whose number is not above those added is not added again, so a
    batch may be repeated.  There is no base; ``partition`` prunes all parts.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str, keys: tuple[str, ...], partition: str | None = None,
        fan: int = FAN, combine: dict[str, Callable[[str], Column]] | None = None,
    ):
        schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        super().__init__(spark, path, schema, keys, fan=fan, share=math.inf)
        self.partition, self.combine = partition, combine or {}

    def parts(self) -> list[Part]:
        complete = self._complete()
        return [p for p in complete if not any(o.covers(p) for o in complete)]

    def last(self) -> int:
        """The last number that was added, 0 before the first."""
        return max((p.last for p in self.parts()), default=0)

    def add(self, rows: DataFrame, number: int) -> None:
        """Add delta ``number``, from 1 on."""
        if number > self.last():
            self._write(rows.select(*self.schema.names), Part(0, number, number))
            self.compact()

    def read(self) -> DataFrame:
        """One row per key; filters on keys reach the files."""
        return self._newest(self.parts())

    def upsert(self, rows: DataFrame) -> None:
        raise ValueError("deltas are added to sums by number")

    def compact(self) -> None:
        self._merge_levels(self.parts())

    def _newest(self, deltas: list[Part]) -> DataFrame:
        every = self.spark.createDataFrame([], self.schema)
        for part in deltas:
            every = every.unionByName(self._of(part))
        sums = [c for c in self.schema.names if c not in self.keys]
        return every.groupBy(*self.keys).agg(*[self.combine.get(c, F.sum)(c).alias(c) for c in sums]).select(*self.schema.names)

    def _write(self, rows: DataFrame, part: Part) -> None:
        path = f"{self.path}/{part.name}"
        if not self.partition:
            rows.hint("rebalance").write.mode("overwrite").parquet(path)
            return
        # Sorted, so that few row groups hold the keys that are asked for.
        rows = rows.hint("rebalance", F.col(self.partition)).sortWithinPartitions(self.partition, *self.keys)
        rows.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP_BYTES)).partitionBy(self.partition).parquet(path)
