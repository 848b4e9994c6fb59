"""A stand-in row for an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def or_placeholder(df: DataFrame, **values: object) -> DataFrame:
    """``df``, or one row of ``values`` (null where not given) when it is empty."""
    nothing = df.limit(1).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 0)
    row = [
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ]
    return df.unionByName(nothing.select(*row))
