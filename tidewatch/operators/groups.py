"""Facts about groups of rows, joined back without gathering a group in one task.

A group (the copies of an id, the events of a batch) may hold a large part of
all rows.  Its facts come from a partial aggregation; facts of the few large
groups are broadcast, and their rows are spread over the join by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Groups above this size are "large": at most rows / LARGE_GROUP of them exist,
# which bounds the broadcast (a million groups per 10**12 rows).
LARGE_GROUP = 1_000_000


def join_group_facts(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    size: str,
    salt: Column,
    large: int = LARGE_GROUP,
) -> DataFrame:
    """Left join of ``facts`` (one row per key, group size in ``size``) to ``rows``.

    ``key`` is a string column; ``salt`` differs between the rows of a group.
    """
    names = [c for c in facts.columns if c not in (key, size)]
    packed = facts.select(F.col(key).alias("_k"), size, F.struct(*names).alias("_f"))
    few = packed.where(F.col(size) > large).select(F.col("_k").alias(key), F.col("_f").alias("_large"))
    many = packed.where(F.col(size) <= large).select("_k", "_f")

    joined = rows.join(F.broadcast(few), key, "left")
    # A salted key of a large group matches nothing and lands anywhere.
    where_to = F.when(F.col("_large").isNull(), F.col(key)).otherwise(
        F.concat(F.col(key), F.lit("#"), F.xxhash64(salt).cast("string"))
    )
    joined = joined.withColumn("_at", where_to).join(many, F.col("_at") == F.col("_k"), "left")
    fact = F.coalesce("_large", "_f")
    return joined.select(*rows.columns, *[fact[name].alias(name) for name in names])
