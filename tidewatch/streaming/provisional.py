"""Provisional KPIs of all days, cheap to correct: a late row is merged into its day.

Per day a theta sketch of the users and plain counts are kept, as deltas of the
micro-batches that are merged by size.  A sketch of 2^k entries is exact up to
that many users; beyond, its relative standard error is 1 / sqrt(2^k - 1).
Nothing is dropped: a day that is open still, or closed, takes late rows alike.
Repeated ids count again, except as users; ``streaming/dayparts.py`` is exact.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas as S
from tidewatch.functions.scores import rate
from tidewatch.sources.keyed import SumTable

# Binary logarithm of a sketch's entries: 16 KB to 64 KB a day, 1.6 % standard error.
ENTRIES = 12


class ProvisionalDays:
    """Sketches and counts per day below ``root``; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, entries: int = ENTRIES):
        self.entries = entries
        self.days = SumTable(
            spark, root, "event_date date, users binary, completed long, value double, failed long, timely long", ("event_date",),
            combine={"users": lambda c: F.theta_union_agg(c, entries)},
        )

    def error(self, deviations: float = 3.0) -> float:
        """Relative error of a user count that so many standard deviations allow."""
        return deviations / math.sqrt(2**self.entries - 1)

    def add(self, batch: DataFrame, number: int) -> None:
        """Merge micro-batch ``number``, from 1 on; one that is repeated changes nothing.

        Rows without a time belong to no day.
        """
        kind = F.col("event_type")
        done = kind == "transaction_completed"
        grace = F.make_dt_interval(mins=F.lit(S.FUTURE_GRACE_MINUTES))
        days = batch.where("ts_event is not null").groupBy(F.to_date("ts_event").alias("event_date")).agg(
            F.theta_sketch_agg("user_id", self.entries).alias("users"),
            F.count_if(done).alias("completed"),
            F.coalesce(F.sum(F.when(done, F.col("value"))), F.lit(0.0)).alias("value"),
            F.count_if(kind == "transaction_failed").alias("failed"),
            F.count_if(F.col("ts_event") <= F.col("ts_ingested") + grace).alias("timely"),
        )
        self.days.add(days, number)

    def read(self, delay_days: int = 2) -> DataFrame:
        """One row per day.  The newest ``delay_days`` days are open; an event from the future closes none."""
        days = self.days.read()
        newest = days.agg(F.max(F.when(F.col("timely") > 0, F.col("event_date")))).first()[0]
        closed = F.lit(False) if newest is None else F.col("event_date") <= F.lit(newest - timedelta(days=delay_days))
        return days.select(
            "event_date",
            F.theta_sketch_estimate("users").alias("dau_approx"),
            F.col("completed").alias("tx_completed_count"),
            F.col("value").alias("tx_completed_value"),
            rate(F.col("failed"), F.col("failed") + F.col("completed")).alias("tx_fail_rate"),
            (~closed).alias("is_open"),
        )


def provisional_stream(days: ProvisionalDays, events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of events into its days."""

    def work(batch: DataFrame, number: int) -> None:
        days.add(batch, number + 1)

    writer = events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
