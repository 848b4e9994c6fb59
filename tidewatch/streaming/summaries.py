"""Summaries per day that micro-batches add to: frequent property keys and drift sketches.

Both are kept as deltas of the batches, merged by size; a late row is added to
its day without reading it again.  A repeated micro-batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas as S
from tidewatch.operators import heavy, screening
from tidewatch.sources.keyed import SumTable

_SUMMARY = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"


class KeySummaries:
    """Frequent property keys per day below ``root``; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, tracked: int = heavy.TRACKED):
        self.tracked = tracked
        self.days = SumTable(
            spark, root, f"event_date date, summary {_SUMMARY}, n_keys long", ("event_date",),
            combine={"summary": lambda c: F.expr(f"approx_top_k_combine({c}, {tracked})")},
        )

    def add(self, batch: DataFrame, number: int) -> None:
        self.days.add(heavy.key_summaries(heavy.property_keys(batch), self.tracked), number)

    def top(self, events: DataFrame, limit: int = S.TOP_PROPERTY_KEYS) -> DataFrame:
        """The most frequent keys of the stored events by their kept summaries."""
        return heavy.top_keys(heavy.property_keys(events), limit, self.days.read(), self.tracked)


class DriftSketches:
    """Value sketches per check and day below ``root``; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, checks: dict[str, str] = S.DRIFT_CHECKS, k: int = screening.K):
        self.checks, self.k = checks, k
        self.days = SumTable(
            spark, root, "name string, event_date date, sketch binary, n long, n_nan long", ("name", "event_date"),
            combine={"sketch": lambda c: F.kll_merge_agg_double(c)},
        )

    def add(self, batch: DataFrame, number: int) -> None:
        self.days.add(screening.day_sketches(batch, self.checks, self.k), number)

    def drift(self, events: DataFrame) -> DataFrame:
        """Verdicts by the kept sketches; ``events`` are read only for the days these leave open."""
        return screening.screened_drift(events, self.days.read(), checks=self.checks, k=self.k)


def summary_stream(
    stores: list[KeySummaries | DriftSketches], events: DataFrame, checkpoint: str
) -> StreamingQuery:
    """Add every micro-batch of accepted events to each store."""

    def work(batch: DataFrame, number: int) -> None:
        for store in stores:
            store.add(batch, number + 1)

    writer = events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
