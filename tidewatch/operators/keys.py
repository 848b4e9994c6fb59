"""Surrogate ids derived from natural keys, stable under retries and reruns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def surrogate_id(*parts: Column) -> Column:
    """60-bit id from the MD5 of the joined parts (nulls as empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")
