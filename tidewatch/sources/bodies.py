"""Request bodies: the raw form in which event batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import schemas as S


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"batch_id", "received_at", "body"}`` from a landing folder."""
    return spark.read.schema(S.REQUEST_BODIES).json(path)


def stream_bodies(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same folder as a stream of newly arriving files."""
    reader = spark.readStream.schema(S.REQUEST_BODIES)
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(path)


def kafka_bodies(spark: SparkSession, **options: str) -> DataFrame:
    """A Kafka topic of request bodies; needs the Kafka package on the class path."""
    reader = spark.readStream.format("kafka")
    for name, value in options.items():
        reader = reader.option(name.replace("_", "."), value)
    return bodies_from_kafka(reader.load())


def bodies_from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records as request bodies; topic, partition and offset name the batch."""
    name = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return records.select(
        name.alias("batch_id"),
        F.col("timestamp").alias("received_at"),
        F.col("value").cast("string").alias("body"),
    )
