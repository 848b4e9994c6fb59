"""Insert-or-replace by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge(
    old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or put in place of equal keys.

    Columns in ``keep`` stay as first inserted.  ``new`` has one row per key.
    """
    incoming = new.select(old.columns)
    if keep:
        first = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        incoming = incoming.join(first, keys, "left").select(*[
            F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns
        ])
    untouched = old.join(new.select(*keys), keys, "left_anti").select(old.columns)
    return untouched.unionByName(incoming)
