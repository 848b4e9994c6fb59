"""Shifts in the share of events each source system contributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch import schemas as S


def source_counts(events: DataFrame) -> DataFrame:
    """Events per source and day."""
    return events.groupBy("source_system", "event_date").agg(F.count(F.lit(1)).alias("n"))


def _shares(by_source: DataFrame) -> DataFrame:
    # One row per calendar day.
    by_day = by_source.groupBy("event_date").agg(F.sum("n").alias("day_total"))
    return by_source.join(F.broadcast(by_day), "event_date").withColumn("share", F.col("n") / F.col("day_total"))


def source_shares(events: DataFrame) -> DataFrame:
    """Events per source and day with the source's share of that day."""
    return _shares(source_counts(events))


def share_history(events: DataFrame) -> DataFrame:
    """Each share against the days before it on which the source appears."""
    return _history(source_counts(events))


def _history(by_source: DataFrame) -> DataFrame:
    week = (
        Window.partitionBy("source_system")
        .orderBy(F.unix_date("event_date"))
        .rangeBetween(-S.BASELINE_DAYS, -1)
    )
    return _shares(by_source).select(
        F.col("event_date").alias("report_date"),
        "source_system",
        F.col("share").alias("current_share"),
        F.count("share").over(week).alias("n_days"),
        F.avg("share").over(week).alias("baseline_mean"),
        F.stddev_samp("share").over(week).alias("baseline_std"),
    )


def source_bias(events: DataFrame) -> DataFrame:
    """Sources whose share lies at least 2.5 standard deviations off its week."""
    return bias_of_counts(source_counts(events))


def bias_of_counts(by_source: DataFrame) -> DataFrame:
    """The same from events per source and day."""
    judged = _history(by_source).where(
        (F.col("n_days") >= S.BIAS_MIN_DAYS) & (F.col("baseline_std") > 0)
    )
    z = (F.col("current_share") - F.col("baseline_mean")) / F.col("baseline_std")
    return judged.withColumn("z_score", z).where(F.abs("z_score") >= S.BIAS_Z).drop("n_days")
