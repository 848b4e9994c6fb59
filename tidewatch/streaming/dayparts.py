"""KPIs of days from partial states that batches add to, so a late event does not re-read its day.

Per day there are

- counts: completed transactions and their value, failures, and distinct users.
  A batch adds the users it is the first to bring on a day; which those are is
  looked up in an index of (day, user), whose buckets are read as its users ask;
- latencies: how often each value occurs, sorted by cell, and the totals of the
  cells.  A cell is a narrow range of values, the same on all days.  The totals
  tell which one or two cells hold a percentile, and only these are read by
  value, so the percentile is exact.

States are sums over deltas, one per batch, merged by size (``sources/keyed.py``).
A batch has a number; one that is repeated adds nothing.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.scores import any_of, rate
from tidewatch.operators import kpis
from tidewatch.operators.percentiles import ranked_percentiles
from tidewatch.sources.ids import BUCKET_IDS, IdIndex
from tidewatch.sources.keyed import SumTable
from tidewatch.sources.staging import file_system, is_complete, stage
from tidewatch.sources.tables import Tables

# Cells of a doubling of the value: each is 0.3 % wide.
CELLS = 256
# Above any cell of a finite value: their binary logarithms lie between -1074 and 1024.
_BEYOND = 1100 * CELLS
LATENCY = {"latency_p95_ms": 0.95}


def cell_of(value: Column) -> Column:
    """Number of a value's cell, in the order of the values; infinity, then NaN come last."""
    size = F.floor(F.log2(F.abs(value)) * CELLS).cast("int") + F.lit(2 * _BEYOND)
    finite = F.when(value > 0, size).when(value < 0, -size).otherwise(0)
    last = F.lit(4 * _BEYOND)
    infinity = F.lit(float("inf"))
    return F.when(F.isnan(value), last + 1).when(value == infinity, last).when(value == -infinity, -last).otherwise(finite)


class DayParts:
    """The partial states below ``root``; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, bucket_ids: int = BUCKET_IDS):
        self.spark, self.root = spark, root.rstrip("/")
        self.counts = SumTable(
            spark, f"{self.root}/counts", "event_date date, users long, completed long, value double, failed long", ("event_date",)
        )
        self.cells = SumTable(
            spark, f"{self.root}/cells", "event_date date, cell int, n long", ("event_date", "cell"), "event_date"
        )
        self.latencies = SumTable(
            spark, f"{self.root}/latencies", "event_date date, cell int, value double, n long",
            ("event_date", "cell", "value"), "event_date",
        )
        self.users = IdIndex(spark, f"{self.root}/users", bucket_ids)

    def add(self, rows: DataFrame, number: int) -> None:
        """Add the accepted events of batch ``number`` (from 1 on); each event comes in one batch only.

        Counts come last: a number they have is done.
        """
        if number <= self.counts.last():
            return
        new = self._new_users(rows, number)
        if found := new.count():
            self.users.add(new, found)
            self.users.compact()
        value = F.col("value")
        samples = rows.where((F.col("event_type") == "system_latency") & value.isNotNull())
        values = samples.groupBy("event_date", cell_of(value).alias("cell"), "value").agg(F.count(F.lit(1)).alias("n"))
        values = stage(values, "batch-latencies")
        self.latencies.add(values, number)
        self.cells.add(values.groupBy("event_date", "cell").agg(F.sum("n").alias("n")), number)
        kind = F.col("event_type")
        done = kind == "transaction_completed"
        counts = rows.groupBy("event_date").agg(
            F.count_if(done).alias("completed"),
            F.coalesce(F.sum(F.when(done, value)), F.lit(0.0)).alias("value"),
            F.count_if(kind == "transaction_failed").alias("failed"),
        )
        users = new.groupBy("event_date").agg(F.count(F.lit(1)).alias("users"))
        self.counts.add(counts.join(users, "event_date", "left").fillna(0, ["users"]), number)

    def _new_users(self, rows: DataFrame, number: int) -> DataFrame:
        """(day, user) that no earlier batch had; found once, a repeated batch reads them."""
        at = f"{self.root}/new-users/{number}"
        if not is_complete(self.spark, at):
            named = rows.where("user_id is not null")
            pairs = named.select("event_date", F.concat_ws("|", "event_date", "user_id").alias("event_id")).distinct()
            pairs = stage(pairs, "batch-users")
            stage(pairs.join(self.users.known(pairs).distinct(), "event_id", "left_anti"), "new-users", at=at)
        self._forget(f"{self.root}/new-users/{number - 2}")
        return self.spark.read.schema("event_date date, event_id string").parquet(at)

    def _forget(self, path: str) -> None:
        fs, old = file_system(self.spark, path)
        fs.delete(old, True)

    def kpis(self, days: list[date]) -> DataFrame:
        """The wide KPIs of ``days`` (those that have events), as ``operators.kpis.daily_kpis`` gives them."""
        counts = self.counts.read().where(F.col("event_date").isin(days))
        wide = counts.select(
            "event_date",
            F.col("users").cast("double").alias("dau"),
            F.col("completed").cast("double").alias("tx_completed_count"),
            F.col("value").alias("tx_completed_value"),
            rate(F.col("failed"), F.col("failed") + F.col("completed")).alias("tx_fail_rate"),
        )
        # One row per day.
        return wide.join(F.broadcast(self._percentiles(days, LATENCY)), "event_date", "left")

    def _percentiles(self, days: list[date], wanted: dict[str, float]) -> DataFrame:
        """Exact percentiles: values are read of the cells alone that hold a wanted rank."""
        day = Window.partitionBy("event_date")
        upto = day.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # A day has some thousand cells, whatever its events.
        placed = self.cells.read().where(F.col("event_date").isin(days)).select(
            "*", F.sum("n").over(day).alias("_n"), F.sum("n").over(upto).alias("_upto")
        )
        places = [(F.col("_n") - 1) * F.lit(p) for p in wanted.values()]
        ranks = [rank for place in places for rank in (F.floor(place), F.ceil(place))]
        holds = any_of([(F.col("_upto") - F.col("n") <= rank) & (rank < F.col("_upto")) for rank in ranks])
        placed = stage(placed.select("event_date", "cell", "n", "_n", holds.alias("_holds")), "day-cells")
        held = placed.where("_holds").select("event_date", "cell", "_n")
        # Two cells per day and percentile at most; as literals they prune the files.
        cells = sorted({row["cell"] for row in held.select("cell").distinct().collect()})
        read = self.latencies.read().where(F.col("event_date").isin(days) & F.col("cell").isin(cells))
        inside = read.join(F.broadcast(held), ["event_date", "cell"]).select(
            F.col("event_date").alias("_day"), "_n", F.col("cell").alias("_zone"), F.col("value").alias("_kept"), F.col("n").alias("_c")
        )
        outside = placed.where("not _holds").select(
            F.col("event_date").alias("_day"), "_n", F.col("cell").alias("_zone"), F.lit(None).cast("double").alias("_kept"),
            F.col("n").alias("_c"),
        )
        return ranked_percentiles(inside.unionByName(outside), "event_date", wanted)


def maintain(tables: Tables, parts: DayParts, batch: DataFrame, number: int, as_of: datetime | Column) -> None:
    """Store the events of micro-batch ``number`` that are not stored yet, and bring the KPIs of their days up to date.

    Events that were stored before the first micro-batch are added to the parts
    once; from then on all events must come this way.
    """
    at = f"{parts.root}/batches/{number}"
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    # Also of an empty table, so that it is not done again once there are events.
    parts.add(tables.read("events_raw"), 1)
    repeated = is_complete(parts.spark, at)
    if not repeated:
        rows = stage(batch, "events")
        stage(rows.join(tables.stored_ids(rows), "event_id", "left_anti").select(rows.columns), "fresh", at=at)
    fresh = parts.spark.read.schema(batch.schema).parquet(at)
    store = tables.append_new if repeated else tables.append
    store("events_raw", fresh)
    parts.add(fresh, number + 2)
    # One value per day.
    days = [row[0] for row in fresh.select("event_date").distinct().collect()]
    if days:
        tables.upsert("metrics_daily", kpis.kpi_rows(parts.kpis(days)).withColumn("computed_at", moment))
    # The stream repeats its last micro-batch only.
    parts._forget(f"{parts.root}/batches/{number - 2}")


def kpi_parts_stream(tables: Tables, parts: DayParts, events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Exact daily KPIs after every micro-batch of accepted events; the days are not read again."""

    def work(batch: DataFrame, number: int) -> None:
        maintain(tables, parts, batch, number, F.current_timestamp())

    writer = events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
