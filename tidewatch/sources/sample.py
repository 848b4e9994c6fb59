"""Adapter from the sample ``events`` table to the event model.

The sample table has plain numbers for ids and no faults.  The rules below
name the event and source of each row and mark which rows carry a null, a
repeat or an invalid field; every row of the table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Sample event type -> event type.
TYPE_OF = {
    "purchase": "transaction_completed",
    "error": "transaction_failed",
    "view": "system_latency",
    "signup": "transaction_initiated",
    "click": "user_access",
}
SOURCES = ("payments", "core", "web")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = spark.read.parquet(f"{sf_dir}/events.parquet")
    return model_columns(sample)


_NAMED = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in TYPE_OF.items())
_VALUE = "if(event_id % 97 <> 0, value, null)"


def model_columns(sample: DataFrame) -> DataFrame:
    """The event model plus ``_id`` (the sample's number)."""
    return sample.selectExpr(
        "event_id AS _id",
        "concat('00000000-0000-0000-0000-', lpad(cast(event_id AS string), 12, '0')) AS event_id",
        "cast(ts AS timestamp) AS ts_event",
        "cast(ts AS timestamp) + make_dt_interval(0, 0, 0, event_id % 900) AS ts_ingested",
        f"CASE event_type {_NAMED} END AS event_type",
        f"element_at(array{SOURCES}, cast(user_id % 3 + 1 AS int)) AS source_system",
        "if(event_id % 50 <> 0, cast(user_id AS string), null) AS user_id",
        f"{_VALUE} AS value",
        f"{_VALUE} * 0.01D AS measurement_uncertainty",
        """if(event_id % 3 = 0, '{"k":1,"currency":"EUR"}', props) AS properties""",
        "to_date(ts) AS event_date",
    )


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events: unique ids, some null users and values."""
    return _base(spark, sf_dir).drop("_id")


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events whose properties also have a key for type, source and whole value: many rare keys."""
    return events_raw(spark, sf_dir).withColumn("properties", F.expr(
        """concat(substr(properties, 1, length(properties) - 1), ',"', event_type, '":1,"', source_system, '":1,"at_',
            coalesce(cast(floor(value) AS string), 'none'), '":1}')"""
    ))


def lake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked events as another writer may leave them: repeats and null fields."""
    holed = _base(spark, sf_dir).withColumns({
        "source_system": F.expr("if(_id % 71 <> 0, source_system, null)"),
        "event_type": F.expr("if(_id % 83 <> 0, event_type, null)"),
    })
    return _with_repeats(holed).drop("_id", "_copy")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """A second copy of some rows, marked ``_copy`` = 1."""
    return rows.selectExpr("*", "explode(if(_id % 101 = 0, array(0, 1), array(0))) AS _copy")


def feed_columns(base: DataFrame) -> DataFrame:
    """Incoming events with repeats and invalid fields, by batch and position."""
    return feed_columns_of(_with_repeats(base)).drop("_id", "_copy")


def feed_columns_of(rows: DataFrame) -> DataFrame:
    """As ``feed_columns`` for rows with ``_id`` and ``_copy``, which stay."""
    return rows.selectExpr(
        "_id", "_copy",
        "_id div 100 AS batch_id",
        "_id % 100 + _copy * 100 AS seq",
        "event_id",
        "ts_event",
        "ts_ingested + make_dt_interval(_copy) AS ts_ingested",
        "if(_id % 83 = 0, 'unknown_event', event_type) AS event_type",
        "source_system",
        "user_id",
        "value",
        "if(_id % 89 = 0, -1D, measurement_uncertainty) AS measurement_uncertainty",
        "properties",
    )


def ingest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_columns(_base(spark, sf_dir))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest feed with ``slot``, the ten days it arrives in: some rows arrive nine days after their event."""
    return _with_repeats(_base(spark, sf_dir)).transform(
        lambda rows: feed_columns_of(rows).withColumn(
            "slot",
            F.expr("(date_diff(to_date(ts_event), DATE '2024-01-01') + if(_id % 13 = 0, 9, 0) + _copy) div 10").cast("int"),
        ).drop("_id", "_copy")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event."""
    return _base(spark, sf_dir).selectExpr(
        "'POST' AS method",
        "concat('/ingest/', event_type) AS path",
        "if(_id % 61 = 0, 500, 200) AS status",
        "coalesce(value, 0D) AS latency_ms",
    )
