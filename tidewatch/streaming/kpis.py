"""KPIs kept up to date from a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import kpis
from tidewatch.sources.staging import stage
from tidewatch.sources.tables import Tables


def recompute_touched_days(tables: Tables, batch: DataFrame, as_of: datetime | Column) -> None:
    """Append events and upsert the KPIs of the days they touch, late days included.

    Events that are stored already are not stored again, so a batch may be repeated.
    """
    rows = stage(batch, "events")
    tables.append_new("events_raw", rows)
    refresh_days(tables, rows, as_of if isinstance(as_of, Column) else F.lit(as_of))


def refresh_days(tables: Tables, rows: DataFrame, moment: Column) -> None:
    """Recompute the KPIs of the days that stored ``rows`` touch."""
    events = tables.read_touched("events_raw", rows)
    tables.upsert(
        "metrics_daily", kpis.kpi_rows(kpis.daily_kpis(events)).withColumn("computed_at", moment)
    )


def kpi_stream(tables: Tables, events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Exact daily KPIs after every micro-batch of accepted events."""

    def work(batch: DataFrame, _: int) -> None:
        recompute_touched_days(tables, batch, F.current_timestamp())

    writer = events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
