"""First copy of every id, within the rows and against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.groups import LARGE_GROUP, join_group_facts


def mark_first(
    rows: DataFrame, key: str, order: list[str], large: int = LARGE_GROUP
) -> DataFrame:
    """Adds ``is_first``: true on the earliest row of each key by ``order`` (unique)."""
    position = F.struct(*order)
    repeated = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_copies"), F.min(position).alias("_first"))
        .where(F.col("_copies") > 1)
    )
    joined = join_group_facts(rows, repeated, key, "_copies", position, large)
    first = F.col("_first").isNull() | (F.col("_first") == position)
    return joined.select(*rows.columns, first.alias("is_first"))


def mark_known(rows: DataFrame, history: DataFrame, key: str, salt: Column) -> DataFrame:
    """Adds ``is_known`` to the first copies whose key ``history`` holds.

    ``rows`` carries ``is_first``; the other copies are not looked up, so a
    key with many copies is looked up once.
    """
    known = history.select(F.col(key).alias("_k"), F.lit(True).alias("_known"))
    lookup = F.when(F.col("is_first"), F.col(key)).otherwise(
        F.concat(F.col(key), F.lit("#"), F.xxhash64(salt).cast("string"))
    )
    joined = rows.withColumn("_at", lookup).join(known, F.col("_at") == F.col("_k"), "left")
    return joined.select(*rows.columns, F.coalesce("_known", F.lit(False)).alias("is_known"))
