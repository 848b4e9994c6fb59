"""Continuous ingest of event batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewatch.plans import daily
from tidewatch.sources.staging import file_system, lasting_name, stage
from tidewatch.sources.tables import Tables


def _each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def ingest_stream(
    tables: Tables, bodies: DataFrame, checkpoint: str, whole_batches: bool = False
) -> StreamingQuery:
    """Run the batch ingest on every micro-batch: exact against all history.

    The judgement of a micro-batch is kept beside the stream's checkpoint under
    its number.  If it is repeated, that judgement is stored to the end: events,
    quarantine and audit are the same as after one run.  A body that comes again
    in a later micro-batch is a delivery of its own there.
    """
    judged = f"{checkpoint.rstrip('/')}-judged"
    name = lasting_name(tables.spark, f"{judged}/name")

    def work(batch: DataFrame, number: int) -> None:
        daily.ingest(
            tables, stage(batch, "bodies"), whole_batches=whole_batches, judged_at=f"{judged}/{number}",
            origin=f"{name}/{number}",
        )
        # The stream repeats its last micro-batch only.
        fs, old = file_system(tables.spark, f"{judged}/{number - 2}")
        fs.delete(old, True)

    return _each_batch(bodies, work, checkpoint)
