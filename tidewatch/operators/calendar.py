"""Calendar helpers shared by the daily operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def check_range(start: date, end: date) -> None:
    if start > end:
        raise ValueError(f"start {start} is after end {end}")


def days_between(spark: SparkSession, start: date, end: date, name: str) -> DataFrame:
    """One row per calendar day of the closed range."""
    check_range(start, end)
    n_days = (end - start).days + 1
    return spark.range(n_days).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias(name)
    )


def within(day: Column, start: date | None, end: date | None) -> Column:
    """Closed range test; an open end accepts everything on its side."""
    test = F.lit(True)
    if start is not None:
        test = test & (day >= F.lit(start))
    if end is not None:
        test = test & (day <= F.lit(end))
    return test


def fan_out(day: str, name: str, first: int, last: int) -> Column:
    """``day + first .. day + last`` exploded as ``name``."""
    return F.explode(
        F.sequence(F.date_add(F.col(day), first), F.date_add(F.col(day), last))
    ).alias(name)
